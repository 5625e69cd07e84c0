"""Objects around the operators: receptors and generators of grids, lookups, contexts, call
containers and probes. They delegate; the work is in DataFrames or in what is called."""

from __future__ import annotations

import importlib
import threading
import tracemalloc
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from contextlib import ExitStack, contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import Grid
from gridloom.operators import regions, windows


class Receptor:
    """Senses a grid: points, windows, matches."""

    def __init__(self, grid: Grid):
        self.grid = grid

    def point(self, index) -> DataFrame:
        """Key columns and v of one cell."""
        return regions.get_item(self.grid, index)

    def passive(self, window, **kw) -> Grid:
        return windows.passive(self.grid, window, **kw)

    def active(self, template, **kw) -> Grid:
        return windows.active(self.grid, template, **kw)

    def match(self, template, **kw) -> Grid:
        return windows.data_match(self.grid, template, **kw)


class Generator:
    """Makes a grid out of another, step by step; ``grid`` is what stands now."""

    def __init__(self, grid: Grid):
        self.grid = grid

    def set_point(self, index, value: float) -> Generator:
        self.grid = regions.set_item(self.grid, index, value)
        return self

    def copy(self, source: Grid, **region) -> int:
        """Write a region of ``source``; the number of cells written."""
        self.grid, n = regions.copy_region(self.grid, source, **region)
        return n

    def generate(self, step: Callable[..., Grid], *args, **kw) -> Generator:
        self.grid = self.grid.transform(step, *args, **kw)
        return self


class Delegate:
    """Hands what it does not have on to what it holds."""

    def __init__(self, held):
        self._held = held

    def __getattr__(self, name: str):
        return getattr(self._held, name)


class Lookup:
    """A mapping kept in a table of key and value; assignments give the later value."""

    def __init__(self, table: DataFrame, key: str = "key", value: str = "value"):
        self.table = table.select(F.col(key).alias("key"), F.col(value).alias("value"))

    def get(self, wanted: DataFrame, key: str, default=None) -> DataFrame:
        """``wanted`` with a column value."""
        got = wanted.join(self.table, wanted[key] == self.table["key"], "left").drop(self.table["key"])
        return got if default is None else got.withColumn("value", F.coalesce("value", F.lit(default)))

    def put(self, more: DataFrame) -> Lookup:
        """With the rows (key, value) set."""
        new = more.select("key", "value")
        return Lookup(self.table.join(new.select("key"), "key", "left_anti").unionByName(new))

    def contains(self, wanted: DataFrame, key: str) -> DataFrame:
        here = self.table.select(F.col("key").alias("_k"), F.lit(True).alias("_in")).distinct()
        return wanted.join(here, wanted[key] == here["_k"], "left").drop("_k").withColumn("contained", F.coalesce("_in", F.lit(False))).drop("_in")

    def keys(self) -> DataFrame:
        return self.table.select("key")

    def items(self) -> DataFrame:
        return self.table


@contextmanager
def contexts(*managers) -> Iterator[list]:
    """All of the contexts entered in order; those that were entered are left in reverse order, also
    if entering a later one fails."""
    with ExitStack() as stack:
        yield [stack.enter_context(m) for m in managers]


class Calls:
    """Named functions of a module or a mapping; ``column`` makes one a column function."""

    def __init__(self, source: str | Mapping[str, Callable]):
        self.source = importlib.import_module(source) if isinstance(source, str) else dict(source)

    def get(self, name: str) -> Callable:
        f = self.source.get(name) if isinstance(self.source, dict) else getattr(self.source, name, None)
        if not callable(f):
            raise KeyError(name)
        return f

    def call(self, name: str, *args, **kw):
        return self.get(name)(*args, **kw)

    def column(self, name: str, returns: str, *columns: str | Column) -> Column:
        """The function over columns, in Arrow batches; it is called once a row."""
        f = self.get(name)

        @F.udf(returns, useArrow=True)
        def run(*values):
            return f(*values)

        return run(*columns)


def run_in_thread(f: Callable, *args, **kw) -> threading.Thread:
    """Start a function beside the driver's other work."""
    thread = threading.Thread(target=f, args=args, kwargs=kw, daemon=True)
    thread.start()
    return thread


class MemoryProbe:
    """Bytes that the driver's Python holds more after a block than before, and the peak within it."""

    def __enter__(self) -> MemoryProbe:
        self._mine = not tracemalloc.is_tracing()
        if self._mine:
            tracemalloc.start()
        tracemalloc.reset_peak()
        self._before = tracemalloc.get_traced_memory()[0]
        return self

    def __exit__(self, *_) -> None:
        now, peak = tracemalloc.get_traced_memory()
        self.grown, self.peak = now - self._before, peak - self._before
        if self._mine:
            tracemalloc.stop()


class ErrorWatcher:
    """Counts calls and errors of functions, by name and kind of error."""

    def __init__(self, keep: bool = False):
        self.keep, self.stats = keep, Counter()

    def watch(self, f: Callable) -> Callable:
        def watched(*args, **kw):
            self.stats[f.__name__, "calls"] += 1
            try:
                return f(*args, **kw)
            except Exception as e:
                self.stats[f.__name__, type(e).__name__] += 1
                if not self.keep:
                    raise
                return None

        return watched


class TraceProbe:
    """Records the calls of functions: name, arguments, result."""

    def __init__(self):
        self.calls: list[tuple] = []

    def trace(self, f: Callable) -> Callable:
        def traced(*args, **kw):
            out = f(*args, **kw)
            self.calls.append((f.__name__, args, kw, out))
            return out

        return traced
