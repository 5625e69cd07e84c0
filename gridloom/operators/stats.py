"""Statistics of whole grids, and chains over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid


def mean(g: Grid) -> DataFrame:
    return g.df.groupBy(*g.by).agg(F.avg("v").alias("v"))


def variance(g: Grid) -> DataFrame:
    """Population variance."""
    return g.df.groupBy(*g.by).agg(F.var_pop("v").alias("v"))


def total(g: Grid) -> DataFrame:
    return g.df.groupBy(*g.by).agg(F.sum("v").alias("v"))


def product(g: Grid) -> DataFrame:
    return g.df.groupBy(*g.by).agg(F.product("v").alias("v"))


def multiple_chain(array: Column | str, base: int | float = 1) -> Column:
    """Product of an array; whole numbers stay whole."""
    kind = "bigint" if isinstance(base, int) else "double"
    return F.aggregate(array, F.lit(base).cast(kind), lambda a, x: a * x.cast(kind))


def add_chain(array: Column | str, base: int | float = 0) -> Column:
    kind = "bigint" if isinstance(base, int) else "double"
    return F.aggregate(array, F.lit(base).cast(kind), lambda a, x: a + x.cast(kind))


def reduce(array: Column | str, start: Column, merge) -> Column:
    return F.aggregate(array, start, merge)
