"""Seconds for the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line.

Each query is written to Spark's no-op sink, so that every row is made and none is collected. The
first run of a query warms the JVM up; the value is the median of the runs after it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "passive_1d_cosmod",
    "passive_1d_step",
    "passive_2d_d10",
    "passive_2d_scatter",
    "active_1d",
    "active_2d",
    "mean_local_2d",
    "local_variance_2d",
    "data_match",
    "copy_region",
    "threshold_map",
    "tensor_add",
    "tensor_variance",
    "chain_dot",
    "dft_rows",
    "power_spectrum",
    "graph_degrees",
    "graph_distances",
    "graph_components",
    "prob_union",
    "store_fold",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from gridloom.plans import catalog

    queries, took = catalog.queries(), {}
    for name in [n for n in HEADLINE if n in queries]:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus, "runs": RUNS}))


if __name__ == "__main__":
    main()
