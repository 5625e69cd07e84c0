"""What becomes of the three sums of a window: a = sum x*x, b = sum y*y, ab = sum x*y."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Combiner = Callable[[Column, Column, Column], Column]


def _guarded(a: Column, b: Column, value: Column) -> Column:
    # tests the product: norms so small that it underflows count as zero
    return F.when(a * b != 0, value).when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def cos(a: Column, b: Column, ab: Column) -> Column:
    return _guarded(a, b, ab / F.sqrt(a * b))


def mod(a: Column, b: Column, ab: Column) -> Column:
    return _guarded(a, b, 2 * F.sqrt(a * b) / (a + b))


def cosmod(a: Column, b: Column, ab: Column) -> Column:
    return _guarded(a, b, 2 * ab / (a + b))


def convolution(a: Column, b: Column, ab: Column) -> Column:
    return ab


COMBINERS: dict[str, Combiner] = {"cos": cos, "mod": mod, "cosmod": cosmod, "convolution": convolution}


def combiner(algorithm: str | Combiner) -> Combiner:
    """A registered name, or any function of three columns to a column."""
    if callable(algorithm):
        return algorithm
    if algorithm not in COMBINERS:
        raise ValueError(f"unknown combiner {algorithm!r}")
    return COMBINERS[algorithm]


def python_combiner(f: Callable[[float, float, float], float], on_error: str = "fail") -> Combiner:
    """A plain Python function of the three sums, called once for each output cell, in Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, ab: pd.Series) -> pd.Series:
        out = []
        for x, y, z in zip(a, b, ab):
            try:
                out.append(float(f(x, y, z)))
            except Exception:
                if on_error != "zero":
                    raise
                out.append(0.0)
        return pd.Series(out, dtype=float)

    return lambda a, b, ab: run(a, b, ab)
