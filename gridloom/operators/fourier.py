"""Discrete Fourier transforms along the axes of a grid. Complex grids have columns re and im.

``direct`` multiplies every cell with every frequency and adds up, in SQL, with partial sums before
the shuffle; ``fft`` hands each line to numpy (a line must fit a task). ``auto`` takes direct up to
DIRECT cells a line.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid, coordinates

DIRECT = 64


def _axes(g: Grid, axis: int | Sequence[int] | None) -> list[int]:
    if axis is None:
        return list(range(g.rank))
    return [a % g.rank for a in ([axis] if isinstance(axis, int) else axis)]


def _as_complex(g: Grid) -> DataFrame:
    if "re" in g.df.columns:
        return g.df.select(*g.pick("re", "im"))
    return g.df.select(*g.pick(F.col("v").alias("re"), F.lit(0.0).alias("im")))


def _direct(g: Grid, df: DataFrame, axis: str, n: int, sign: int) -> DataFrame:
    # k*x is reduced modulo n first, so that the angle stays exact for large products
    turn = F.pmod(F.col("_k") * F.col(axis), F.lit(n)) * F.lit(sign * 2 * math.pi / n)
    df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_c", F.cos(turn)).withColumn("_s", F.sin(turn))
    rest = [*g.by, *[a for a in g.axes if a != axis]]
    out = df.groupBy(*rest, "_k").agg(F.sum(F.col("re") * F.col("_c") - F.col("im") * F.col("_s")).alias("re"), F.sum(F.col("re") * F.col("_s") + F.col("im") * F.col("_c")).alias("im"))
    return out.withColumnRenamed("_k", axis).select(*g.pick("re", "im"))


def _fft(g: Grid, df: DataFrame, axis: str, n: int, sign: int) -> DataFrame:
    rest = [*g.by, *[a for a in g.axes if a != axis]]
    names = [*g.by, *g.axes, "re", "im"]

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n, complex)
        x[pdf[axis].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.fft(x) if sign < 0 else np.fft.ifft(x) * n
        first = pdf.iloc[0]
        return pd.DataFrame({c: first[c] for c in rest} | {axis: np.arange(n, dtype=np.int32), "re": y.real, "im": y.imag}, index=range(n))[names]

    return df.groupBy(*rest).applyInPandas(line, df.select(*names).schema)


def _transform(g: Grid, axes: list[int], sign: int, strategy: str) -> DataFrame:
    if g.shape is None:
        raise ValueError("a transform needs the grid's shape")
    df = _as_complex(g)
    for k in axes:
        n = g.shape[k]
        one = strategy if strategy != "auto" else "direct" if n <= DIRECT else "fft"
        df = (_direct if one == "direct" else _fft)(g, df, g.axes[k], n, sign)
    return df


def dft(g: Grid, axis: int | Sequence[int] | None = None, strategy: str = "auto") -> Grid:
    """Sum of x * exp(-2 pi i k x / n) along each axis in turn."""
    return g.with_df(_transform(g, _axes(g, axis), -1, strategy))


def idft(g: Grid, axis: int | Sequence[int] | None = None, strategy: str = "auto", norm: str = "all") -> Grid:
    """The inverse; scaled by the size of the whole grid (``all``), or of the given axes (``axis``)."""
    axes = _axes(g, axis)
    if norm not in ("all", "axis"):
        raise ValueError("norm is 'all' or 'axis'")
    scale = g.size if norm == "all" else math.prod(g.shape[k] for k in axes)
    df = _transform(g, axes, 1, strategy)
    return g.with_df(df.select(*g.pick((F.col("re") / scale).alias("re"), (F.col("im") / scale).alias("im"))))


def power_spectrum(g: Grid, axis: int | Sequence[int] | None = None, strategy: str = "auto") -> Grid:
    df = _transform(g, _axes(g, axis), -1, strategy)
    return g.with_df(df.select(*g.pick((F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v"))))


def _wave(spark: SparkSession, shape, freq, f) -> Grid:
    shape, freq = (tuple([x] if isinstance(x, int) else x) for x in (shape, freq))
    if len(shape) != len(freq) or any(not 0 <= q < n for q, n in zip(freq, shape)):
        raise ValueError("each frequency must lie in its axis")
    cells = spark.range(math.prod(shape)).select(F.lit(0).cast("bigint").alias("tid"), *coordinates(F.col("id"), shape))
    turn = sum((F.col(f"i{k}") * F.lit(q / n) for k, (q, n) in enumerate(zip(freq, shape))), F.lit(0.0)) * (2 * math.pi)
    return Grid(cells.withColumn("v", f(turn)), len(shape), shape)


def dft_kernel_real(spark: SparkSession, shape, freq) -> Grid:
    """cos(2 pi * sum of freq * x / n) over the shape."""
    return _wave(spark, shape, freq, F.cos)


def dft_kernel_imag(spark: SparkSession, shape, freq) -> Grid:
    return _wave(spark, shape, freq, F.sin)
