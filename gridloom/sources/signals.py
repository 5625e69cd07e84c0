"""Signals: a rank-1 grid a key, from a table with an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Grid

WIDTH = 1 << 20


def signal(df: DataFrame, by: str, order: str, value: str, width: int = WIDTH) -> Grid:
    """Number each key's rows by ``order``, a whole number unique within the key.

    Rows are numbered within stretches of ``width`` of the order, and stretches by their counts, so
    a key with a large share of all rows is still many tasks.
    """
    rows = df.select(F.col(by).cast("bigint").alias("tid"), F.col(order).cast("bigint").alias("_o"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("_s", F.floor(F.col("_o") / F.lit(width)))
    counts = rows.groupBy("tid", "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("tid").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tid", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("tid", "_s").orderBy("_o")) - 1)
    return Grid(rows.join(counts, ["tid", "_s"]).select("tid", (F.col("_b") + F.col("_r")).cast("int").alias("i0"), "v"), 1)


def head(g: Grid, n: int) -> Grid:
    """The first ``n`` cells of the keys that have as many, as grids of that shape."""
    cut = g.df.filter(F.col("i0") < n)
    full = cut.groupBy(*g.by).count().filter(F.col("count") == n).select(*g.by)
    return Grid(cut.join(full, list(g.by)), 1, (n,), g.by)
