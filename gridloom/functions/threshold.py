"""Interval predicates. NaN is in no interval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(low: float | None, high: float | None, inclusive: tuple[bool, bool] = (True, True)) -> Callable[[Column], Column]:
    """A predicate on a column; at least one bound, low not above high."""
    if low is None and high is None:
        raise ValueError("a threshold needs a bound")
    if low is not None and high is not None and low > high:
        raise ValueError("low is above high")

    def test(v: Column) -> Column:
        out = ~F.isnan(v)
        if low is not None:
            out = out & (v >= low if inclusive[0] else v > low)
        if high is not None:
            out = out & (v <= high if inclusive[1] else v < high)
        return F.coalesce(out, F.lit(False))

    return test


def threshold_judge(low: float | None = None, high: float | None = None, inclusive: tuple[bool, bool] = (True, True)) -> Callable[[Column], Column]:
    """1 inside the interval, else 0."""
    test = between(low, high, inclusive)
    return lambda v: test(v).cast("int")
