"""Slices, strided region copies, filters and maps over regions of a grid.

A region is start, shape (number of samples) and step for each axis; it is clipped to the grid,
so that along an axis of n cells there are min(shape, ceil((n - start) / step)) samples.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.threshold import between
from gridloom.grid import Grid, coordinates, flatten, infer_shape, per_axis


def region_spec(g: Grid, start=None, shape=None, step=None, *, clip: bool = True):
    """start, shape and step of the samples inside the grid."""
    r = g.rank
    start = per_axis(start, r, [0] * r, "start")
    step = per_axis(step, r, [1] * r, "step")
    if any(s < 0 for s in start) or any(t < 1 for t in step):
        raise ValueError("start must not be negative, step must be positive")
    room = [max(0, -(-(n - s) // t)) for n, s, t in zip(g.shape, start, step)]
    want = per_axis(shape, r, room, "shape")
    if any(n < 0 for n in want):
        raise ValueError("shape must not be negative")
    if not clip and any(w > n for w, n in zip(want, room)):
        raise ValueError("the region leaves the grid")
    return start, tuple(min(w, n) for w, n in zip(want, room)), step


def _inside(g: Grid, start, shape, step) -> Column:
    test = F.lit(True)
    for a, s, n, t in zip(g.axes, start, shape, step):
        c = F.col(a)
        test = test & (c >= s) & (c < s + n * t)
        if t > 1:
            test = test & (F.pmod(c - s, F.lit(t)) == 0)
    return test


def _sample(g: Grid, start, step) -> list[Column]:
    """Sample numbers of the cells of a region."""
    return [(F.floor((F.col(a) - s) / t) if t > 1 else F.col(a) - s).cast("int").alias(a) for a, s, t in zip(g.axes, start, step)]


def load(g: Grid, start=None, shape=None, step=None) -> Grid:
    """The region as a grid of its own; leaving the grid is an error."""
    start, shape, step = region_spec(g, start, shape, step, clip=False)
    return g.with_df(g.df.filter(_inside(g, start, shape, step)).select(*g.by, *_sample(g, start, step), "v"), shape)


def slice_view(g: Grid, *index: int | slice) -> Grid:
    """Basic indexing: whole numbers drop an axis, slices may have negative steps."""
    if len(index) > g.rank:
        raise IndexError("too many indices")
    df, keep, shape = g.df, [], []
    for a, n, at in zip(g.axes, g.shape, [*index, *[slice(None)] * (g.rank - len(index))]):
        if isinstance(at, int):
            if not -n <= at < n:
                raise IndexError("index out of range")
            df = df.filter(F.col(a) == at % n)
            continue
        start, stop, step = at.indices(n)
        count = len(range(start, stop, step))
        first, last = (start, start + step * (count - 1)) if step > 0 else (start + step * (count - 1), start)
        df = df.filter(F.col(a).between(first, last)) if count else df.filter(F.lit(False))
        if abs(step) > 1:
            df = df.filter(F.pmod(F.col(a) - first, F.lit(abs(step))) == 0)
        keep.append(((F.col(a) - start) / step).cast("int"))
        shape.append(count)
    return g.with_df(df.select(*g.by, *[c.alias(f"i{k}") for k, c in enumerate(keep)], "v"), tuple(shape), len(shape))


def copy_region(target: Grid, source: Grid, *, source_start=None, source_step=None, shape=None, target_start=None, target_step=None) -> tuple[Grid, int]:
    """``target`` with the source's region written into it, clipped on both sides, and the number of
    cells written in each grid."""
    if source.rank != target.rank:
        raise ValueError("source and target have different ranks")
    s0, ss, st = region_spec(source, source_start, shape, source_step)
    t0, ts, tt = region_spec(target, target_start, shape, target_step)
    n = tuple(min(a, b) for a, b in zip(ss, ts))
    moved = source.df.filter(_inside(source, s0, n, st)).select(
        *source.by, *[(F.floor((F.col(a) - s) / t) * q + p).cast("int").alias(a) for a, s, t, p, q in zip(source.axes, s0, st, t0, tt)], F.col("v").alias("_new")
    )
    df = target.df.join(moved, [*target.by, *target.axes], "left").select(*target.pick(F.coalesce("_new", "v").alias("v")))
    return target.with_df(df), math.prod(n)


def assign(g: Grid, value, start=None, shape=None, step=None) -> Grid:
    """The region set to a number, or to as many numbers in row-major order."""
    start, shape, step = region_spec(g, start, shape, step, clip=False)
    test = _inside(g, start, shape, step)
    if infer_shape(value) is None:
        return g.with_df(g.df.withColumn("v", F.when(test, F.lit(float(value))).otherwise(F.col("v"))))
    if any(infer_shape(x) is not None for x in value):
        raise ValueError("values must be flat")
    flat = flatten(value)
    if len(flat) != math.prod(shape):
        raise ValueError("the number of values does not fit the region")
    new = g.df.sparkSession.createDataFrame(list(enumerate(flat)), "_n bigint, _new double")
    at = coordinates(F.col("_n"), shape)
    new = new.select(*at, "_new").select(*[(F.col(a) * t + s).cast("int").alias(a) for a, s, t in zip(g.axes, start, step)], "_new")
    return g.with_df(g.df.join(new, g.axes, "left").select(*g.pick(F.coalesce("_new", "v").alias("v"))))


def _at(g: Grid, index) -> Column:
    index = (index,) if isinstance(index, int) else tuple(index)
    if len(index) != g.rank:
        raise IndexError("one index for each axis")
    test = F.lit(True)
    for a, x in zip(g.axes, index):
        test = test & (F.col(a) == x)
    return test


def get_item(g: Grid, index) -> DataFrame:
    """Key columns and v of one cell."""
    return g.df.filter(_at(g, index)).select(*g.by, "v")


def set_item(g: Grid, index, value: float) -> Grid:
    return g.with_df(g.df.withColumn("v", F.when(_at(g, index), F.lit(float(value))).otherwise(F.col("v"))))


def data_filter(g: Grid, predicate: Callable[[Column], Column], *, start=None, shape=None, step=None, origin=None, basis=None) -> DataFrame:
    """Positions origin + basis * sample of the region's cells for which ``predicate`` holds."""
    start, shape, step = region_spec(g, start, shape, step)
    origin = per_axis(origin, g.rank, start, "origin")
    basis = per_axis(basis, g.rank, step, "basis")
    hit = g.df.filter(_inside(g, start, shape, step) & F.coalesce(predicate(F.col("v")), F.lit(False))).select(*g.by, *_sample(g, start, step))
    return hit.select(*g.by, *[(F.lit(o) + F.lit(b) * F.col(a)).cast("int").alias(a) for a, o, b in zip(g.axes, origin, basis)])


def threshold_filter(g: Grid, low: float | None = None, high: float | None = None, *, inclusive=(True, True), **region) -> DataFrame:
    return data_filter(g, between(low, high, inclusive), **region)


def data_mapping(g: Grid, f: Callable[[Column], Column], *, start=None, shape=None, step=None, out: Grid | None = None, out_start=None, out_step=None) -> Grid:
    """``f`` over the region, as a grid of its own or written into ``out``; where ``f`` gives null,
    the cell of ``out`` (or the cell itself) stays as it was."""
    start, shape, step = region_spec(g, start, shape, step)
    mapped = g.df.filter(_inside(g, start, shape, step)).select(*g.by, *_sample(g, start, step), F.coalesce(f(F.col("v")).cast("double"), F.col("v") if out is None else F.lit(None)).alias("v"))
    own = g.with_df(mapped, shape)
    if out is None:
        return own
    return copy_region(out, own.with_df(mapped.filter("v is not null")), target_start=out_start, target_step=out_step)[0]


def threshold_map(g: Grid, pairs: Sequence[tuple[Callable[[Column], Column] | bool, float]], *, default_value: float = 0.0, **region) -> Grid:
    """The value of the first pair whose test holds, else the default."""

    def chain(v: Column) -> Column:
        out = F.lit(float(default_value))
        for test, value in reversed(list(pairs)):
            hit = F.lit(test) if isinstance(test, bool) else F.coalesce(test(v), F.lit(False))
            out = F.when(hit, F.lit(float(value))).otherwise(out)
        return out

    return data_mapping(g, chain, **region)


def get_default(column: str, key, default) -> Column:
    """A map column's entry, or the default: every key is there."""
    return F.coalesce(F.element_at(F.col(column), F.lit(key)), F.lit(default))


def heat_levels(g: Grid) -> Grid:
    """Values scaled to 0..1 between each grid's least and greatest; NaN and constant grids give 0."""
    sound = F.when(~F.isnan("v"), F.col("v"))
    ends = g.df.groupBy(*g.by).agg(F.min(sound).alias("_lo"), F.max(sound).alias("_hi"))
    t = F.when(F.isnan("v") | (F.col("_hi") <= F.col("_lo")) | F.col("_hi").isNull(), F.lit(0.0)).otherwise((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return g.with_df(g.df.join(ends, list(g.by)).select(*g.pick(t.alias("v"))))
