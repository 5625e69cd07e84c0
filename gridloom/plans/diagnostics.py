"""What a plan does and how long it takes."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan, for tests of plans."""
    return Counter(m[1] for line in physical_plan(df).splitlines() if (m := re.search(r"([A-Z][A-Za-z]+)(?: |$|\()", line)))


def exchanges(df: DataFrame) -> int:
    return len(re.findall(r"Exchange (?:hash|range|round|Single)", physical_plan(df)))


@contextmanager
def timed(out: dict, name: str) -> Iterator[None]:
    """Add the seconds of a block to ``out[name]``."""
    began = time.perf_counter()
    try:
        yield
    finally:
        out[name] = out.get(name, 0.0) + time.perf_counter() - began


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that are counted while an action runs."""
    watch = Observation(name)
    return df.observe(watch, *metrics), watch
