"""Element-wise arithmetic between grids of one shape, or a grid and a number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid


NAN = float("nan")


def _with(g: Grid, other: Grid | float, f: Callable[[Column, Column], Column], reflected: bool = False) -> Grid:
    if isinstance(other, Grid):
        if other.rank != g.rank or (g.shape and other.shape and g.shape != other.shape):
            raise ValueError("the grids have different shapes")
        pair = g.df.join(other.df.select(*other.pick(F.col("v").alias("_w"))), [*g.by, *g.axes])
        return g.with_df(pair.select(*g.pick(f(F.col("v"), F.col("_w")).alias("v"))))
    x = F.lit(float(other))
    return g.with_df(g.df.select(*g.pick((f(x, F.col("v")) if reflected else f(F.col("v"), x)).alias("v"))))


def add(g: Grid, other: Grid | float) -> Grid:
    return _with(g, other, lambda a, b: a + b)


def sub(g: Grid, other: Grid | float, reflected: bool = False) -> Grid:
    return _with(g, other, lambda a, b: a - b, reflected)


def mul(g: Grid, other: Grid | float) -> Grid:
    """Element by element."""
    return _with(g, other, lambda a, b: a * b)


def div(g: Grid, other: Grid | float, reflected: bool = False, lenient: bool = False) -> Grid:
    """A zero divisor fails the query; with ``lenient`` it gives null."""
    zero = F.lit(None).cast("double") if lenient else F.raise_error(F.lit("division by zero")).cast("double")
    return _with(g, other, lambda a, b: F.when(b != 0, a / F.when(b != 0, b)).otherwise(zero), reflected)


def power(g: Grid, other: Grid | float) -> Grid:
    """Floating power; 0 to a negative power is infinite, a negative base to a fraction NaN."""
    return _with(g, other, lambda a, b: F.pow(a, b))


def sqrt(g: Grid) -> Grid:
    """Square root of each cell; NaN below zero."""
    return g.with_df(g.df.withColumn("v", F.sqrt("v")))


def neg(g: Grid) -> Grid:
    return g.with_df(g.df.withColumn("v", -F.col("v")))


def pos(g: Grid) -> Grid:
    return g


def norm(g: Grid) -> DataFrame:
    """Square root of the sum of squares."""
    return g.df.groupBy(*g.by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))


def matvec(m: Grid, x: list[float]) -> Grid:
    """Dot product of each row with ``x``; the longer of the two is cut off."""
    weights = F.array(*[F.lit(float(w)) for w in x])
    cells = m.df.filter(F.col("i1") < len(x)).withColumn("_p", F.col("v") * F.element_at(weights, F.col("i1") + 1))
    out = cells.groupBy(*m.by, "i0").agg(F.sum("_p").alias("v"))
    return Grid(out, 1, m.shape[:1] if m.shape else None, m.by)
