from pyspark.sql import functions as F

from gridloom.operators import regions, windows
from gridloom.plans import catalog, diagnostics

SF = "/root/testdata/sf0.01"


def test_one_shuffle_carries_pairs_and_sums(spark):
    df = windows.passive(catalog._events(spark, SF), 3).df
    plan = diagnostics.physical_plan(df)
    # row numbers by stretch, counts, their offsets and join, then one exchange for pair and sums
    assert diagnostics.exchanges(df) <= 6 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scans_read_only_what_is_used(spark):
    plan = diagnostics.physical_plan(catalog.queries()["store_fold"](spark, SF))
    assert "props" not in plan and "ReadSchema" in plan
    judged = diagnostics.physical_plan(spark.read.parquet(f"{SF}/events.parquet").filter(F.col("value") > 5).select("event_id"))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,5.0)]" in judged


def test_element_wise_work_has_no_shuffle(spark):
    g = catalog._vectors(spark, SF)
    for out in (regions.load(g, (1, 1), (9, 9)), regions.slice_view(g, 3), regions.data_mapping(g, F.sqrt), regions.threshold_map(g, [(True, 1.0)])):
        assert diagnostics.exchanges(out.df) == 0


def test_timing_and_observation(spark):
    took = {}
    with diagnostics.timed(took, "count"):
        df, watch = diagnostics.observed(spark.range(10), "rows", F.count("*").alias("n"))
        df.collect()
    assert took["count"] > 0 and watch.get["n"] == 10 and diagnostics.operators(spark.range(3).groupBy("id").count())["HashAggregate"] == 2
