"""Window similarity: a window slides over a grid and is compared with a displaced copy of itself
(passive) or with a template (active); local means and variances are the same sums.

Plans. ``separable``: pair each cell with its partner, then one rolling sum an axis, for windows
that only need sums of all their cells. ``scatter``: send each cell to the windows that hold it and
add up, for any kernel; partial sums are formed before the shuffle. ``lead``: a rank-1 kernel as a
weighted sum of following cells, one sort. ``auto`` takes lead for rank-1 kernels of up to LEAD
cells, scatter for other kernels and for wide steps, else separable.

Rolling sums never put a whole axis into one task: an axis is cut into blocks of BLOCK cells, each
with a halo of the cells that its windows reach into.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.combine import Combiner, combiner
from gridloom.functions.threshold import between
from gridloom.grid import Grid, flatten, infer_shape, per_axis

BLOCK = 1 << 16
LEAD = 64


def _blocked(g: Grid, df: DataFrame, axis: str, halo: int):
    """Rows dealt into blocks along ``axis``, with the first ``halo`` rows of a block also in the
    blocks before it; the window to use, and the test for a block's own rows."""
    block = max(BLOCK, halo)
    own = F.floor(F.col(axis) / block).cast("int")
    df = df.withColumn("_blk", F.explode(F.when(F.pmod(F.col(axis), F.lit(block)) < halo, F.array(own - 1, own)).otherwise(F.array(own)))) if halo else df.withColumn("_blk", own)
    rest = [c for c in g.axes if c != axis]
    return df, Window.partitionBy(*g.by, *rest, "_blk").orderBy(axis), F.col("_blk") == own


def _rolling(g: Grid, df: DataFrame, sums: list[str], window: Sequence[int]) -> DataFrame:
    """Sums over the window that starts at each cell; cells whose window is not complete go."""
    for axis, w in zip(g.axes, window):
        if w > 1:
            df, win, own = _blocked(g, df, axis, w - 1)
            frame = win.rangeBetween(0, w - 1)
            keep = [*g.by, *g.axes]
            df = df.select(*keep, "_blk", F.count("*").over(frame).alias("_n"), *[F.sum(c).over(frame).alias(c) for c in sums])
            df = df.filter(own & (F.col("_n") == w)).select(*keep, *sums)
    return df


def _pairs(g: Grid, df: DataFrame, d: Sequence[int]) -> DataFrame:
    """Every cell with the cell displaced by ``d``, if there is one, as column y."""
    moved = [k for k, x in enumerate(d) if x]
    if not moved:
        return df.withColumn("y", F.col("v"))
    if len(moved) == 1 and d[moved[0]] > 0:
        axis, by = g.axes[moved[0]], d[moved[0]]
        df, win, own = _blocked(g, df, axis, by)
        frame = win.rangeBetween(by, by)
        return df.withColumn("y", F.first("v").over(frame)).withColumn("_c", F.count("*").over(frame)).filter(own & (F.col("_c") == 1)).drop("_blk", "_c")
    other = df.select(*g.by, *[(F.col(a) - x).alias(a) for a, x in zip(g.axes, d)], F.col("v").alias("y"))
    return df.join(other, [*g.by, *g.axes])


def _region(g: Grid, start: Sequence[int], end: Sequence[int] | None) -> DataFrame:
    df = g.df
    for k, a in enumerate(g.axes):
        if start[k]:
            df = df.filter(F.col(a) >= start[k])
        if end is not None and (g.shape is None or end[k] < g.shape[k]):
            df = df.filter(F.col(a) < end[k])
    return df


def output_count(start: Sequence[int], end: Sequence[int], window: Sequence[int], d: Sequence[int], step: Sequence[int]) -> tuple[int, ...]:
    """Number of output cells along each axis."""
    out = []
    for k, (s, e, w, x, t) in enumerate(zip(start, end, window, d, step)):
        room = e - s - w - x
        if room < 0:
            raise ValueError(f"axis {k}: no window fits between start {s} and end {e}")
        out.append(room // t + 1)
    return tuple(out)


class _Geometry:
    def __init__(self, g: Grid, window, d, start, end, step, output_start, output_step):
        r = g.rank
        self.window = window
        self.d = d
        self.start = per_axis(start, r, [0] * r, "start")
        self.step = per_axis(step, r, [1] * r, "step")
        if end is None and g.shape is None:
            self.end = None
        else:
            self.end = per_axis(end, r, g.shape or (), "end")
            if any(e < 0 for e in self.end) or (g.shape is not None and any(e > n for e, n in zip(self.end, g.shape))):
                raise ValueError("end is outside the grid")
        if any(s < 0 for s in self.start):
            raise ValueError("start is outside the grid")
        if any(t < 1 for t in self.step) or any(w < 1 for w in window):
            raise ValueError("step and window must be positive")
        for s, x in zip(self.start, d):
            if s + x < 0:
                raise ValueError("the displaced window leaves the grid")
        self.num = output_count(self.start, self.end, window, [max(x, 0) for x in d], self.step) if self.end else None
        self.out_start = per_axis(output_start, r, [0] * r, "output_start")
        self.out_step = per_axis(output_step, r, [1] * r, "output_step")
        self.explicit = output_start is not None

    def lattice(self, g: Grid, df: DataFrame) -> DataFrame:
        """Windows that start on the lattice, with output coordinates."""
        for a, s, t in zip(g.axes, self.start, self.step):
            if t > 1:
                df = df.filter(F.pmod(F.col(a) - s, F.lit(t)) == 0)
        if self.num:
            for a, s, t, n in zip(g.axes, self.start, self.step, self.num):
                df = df.filter(F.col(a) <= s + t * (n - 1))
        coords = [(F.lit(o) + F.lit(p) * F.floor((F.col(a) - s) / t)).cast("int").alias(a) for a, s, t, o, p in zip(g.axes, self.start, self.step, self.out_start, self.out_step)]
        return df.select(*g.by, *coords, *[c for c in df.columns if c not in (*g.by, *g.axes)])

    def shape(self) -> tuple[int, ...] | None:
        return tuple(o + (n - 1) * p + 1 for n, o, p in zip(self.num, self.out_start, self.out_step)) if self.num else None


def passive(
    g: Grid,
    window: int | Sequence[int] | None = None,
    *,
    w1: float = 1.0,
    w2: float = 1.0,
    b1: float = 0.0,
    b2: float = 0.0,
    start=None,
    end=None,
    step=None,
    d=None,
    algorithm: str | Combiner = "cosmod",
    output_start=None,
    output_step=None,
    strategy: str = "auto",
) -> Grid:
    """Each window against the window displaced by ``d`` (default: one along the first axis).

    x = w1*v + b1, y = w2*v(p+d) + b2 over the window's cells p; the result is
    algorithm(sum x*x, sum y*y, sum x*y). No padding: windows must lie in [start, end).
    """
    r = g.rank
    window = per_axis(window, r, [1] * r, "window")
    d = per_axis(d, r, [1] + [0] * (r - 1), "d")
    geo = _Geometry(g, window, d, start, end, step, output_start, output_step)
    if strategy == "auto":
        strategy = "scatter" if math.prod(window) <= math.prod(geo.step) else "separable"
    x, y = F.col("v") * w1 + b1, F.col("y") * w2 + b2
    df = _pairs(g, _region(g, geo.start, geo.end), d).select(*g.pick((x * x).alias("a"), (y * y).alias("b"), (x * y).alias("ab")))
    sums = ["a", "b", "ab"]
    if strategy == "separable":
        df = geo.lattice(g, _rolling(g, df, sums, window))
    elif strategy == "scatter":
        df = geo.lattice(g, _scatter(g, df, [list(range(w)) for w in window], geo, sums))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return g.with_df(df.select(*g.pick(combiner(algorithm)(F.col("a"), F.col("b"), F.col("ab")).alias("v"))), geo.shape())


def _scatter(g: Grid, df: DataFrame, offsets: list[list[int]], geo: _Geometry, sums: list[str]) -> DataFrame:
    """Each cell to the windows on the lattice that hold it; complete windows only."""
    for a, qs, s, t in zip(g.axes, offsets, geo.start, geo.step):
        if len(qs) > 1 or qs != [0]:
            df = df.withColumn("_q", F.explode(F.array(*[F.lit(q) for q in qs])))
            df = df.withColumn(a, F.col(a) - F.col("_q")).drop("_q")
        df = df.filter((F.col(a) >= s) & (F.pmod(F.col(a) - s, F.lit(t)) == 0))
    full = math.prod(len(q) for q in offsets)
    out = df.groupBy(*g.by, *g.axes).agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in sums])
    return out.filter(F.col("_n") == full).drop("_n")


def _kernel(kernel) -> tuple[tuple[int, ...], list[float]]:
    shape = infer_shape(kernel)
    if shape is None:
        raise ValueError("a kernel is required")
    return shape, flatten(kernel)


def active(
    g: Grid,
    kernel,
    *,
    w1: float = 1.0,
    w2: float = 1.0,
    b1: float = 0.0,
    b2: float = 0.0,
    start=None,
    end=None,
    step=None,
    algorithm: str | Combiner = "cosmod",
    output_start=None,
    output_step=None,
    strategy: str = "auto",
) -> Grid:
    """Each window of the kernel's shape against the kernel (nested lists or an array)."""
    shape, values = _kernel(kernel)
    if len(shape) != g.rank:
        raise ValueError("kernel and grid have different ranks")
    geo = _Geometry(g, shape, [0] * g.rank, start, end, step, output_start, output_step)
    y = [w2 * v + b2 for v in values]
    b = F.lit(float(sum(v * v for v in y)))
    if strategy == "auto":
        strategy = "lead" if g.rank == 1 and len(y) <= LEAD and geo.step == (1,) else "scatter"
    df = _region(g, geo.start, geo.end).select(*g.pick((F.col("v") * w1 + b1).alias("x")))
    if strategy == "lead":
        if g.rank != 1:
            raise ValueError("lead needs a grid of rank 1")
        n = len(y)
        df, win, own = _blocked(g, df, "i0", n - 1)
        frame = win.rangeBetween(0, n - 1)
        ab = sum((F.lead("x", q).over(win) * F.lit(k) for q, k in enumerate(y) if q), F.col("x") * F.lit(y[0]))
        df = df.select(*g.pick("_blk", F.count("*").over(frame).alias("_n"), F.sum(F.col("x") * F.col("x")).over(frame).alias("a"), ab.alias("ab")))
        df = df.filter(own & (F.col("_n") == n)).drop("_blk", "_n")
        df = geo.lattice(g, df)
    elif strategy == "scatter":
        df = _scatter_kernel(g, df, shape, y, geo)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return g.with_df(df.select(*g.pick(combiner(algorithm)(F.col("a"), b, F.col("ab")).alias("v"))), geo.shape())


def _scatter_kernel(g: Grid, df: DataFrame, shape: Sequence[int], y: list[float], geo: _Geometry) -> DataFrame:
    cells = []
    for n, k in enumerate(y):
        q, rest = [], n
        for size in reversed(shape):
            q.append(rest % size)
            rest //= size
        cells.append(F.struct(*[F.lit(x).alias(f"q{j}") for j, x in enumerate(reversed(q))], F.lit(k).alias("k")))
    df = df.withColumn("_q", F.explode(F.array(*cells)))
    df = df.select(*g.by, *[(F.col(a) - F.col(f"_q.q{j}")).alias(a) for j, a in enumerate(g.axes)], "x", F.col("_q.k").alias("k"))
    for a, s, t in zip(g.axes, geo.start, geo.step):
        df = df.filter((F.col(a) >= s) & (F.pmod(F.col(a) - s, F.lit(t)) == 0))
    out = df.groupBy(*g.by, *g.axes).agg(F.count("*").alias("_n"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("x") * F.col("k")).alias("ab"))
    return geo.lattice(g, out.filter(F.col("_n") == len(y)).drop("_n"))


def mean_local(g: Grid, local_size, *, weight=None, start=None, end=None, step=None, output_start=None, output_step=None) -> Grid:
    """Sum of weight * value over the window, divided by the window's number of cells (not by the
    sum of the weights)."""
    size = per_axis(local_size, g.rank, [], "local_size")
    n = math.prod(size)
    if weight is not None:
        flat = flatten(weight)[:n]
        if len(flat) < n:
            raise ValueError("too few weights")
        kernel = flat
        for s in reversed(size[1:]):
            kernel = [kernel[i : i + s] for i in range(0, len(kernel), s)]
        out = active(g, kernel, start=start, end=end, step=step, algorithm="convolution", output_start=output_start, output_step=output_step)
        return out.with_df(out.df.withColumn("v", F.col("v") / n))
    geo = _Geometry(g, size, [0] * g.rank, start, end, step, output_start, output_step)
    df = geo.lattice(g, _rolling(g, _region(g, geo.start, geo.end).select(*g.pick("v")), ["v"], size))
    return g.with_df(df.withColumn("v", F.col("v") / n), geo.shape())


def local_variance(g: Grid, local_size, *, start=None, end=None, step=None, output_start=None, output_step=None) -> Grid:
    """Population variance of each window, as mean of squares less square of the mean."""
    size = per_axis(local_size, g.rank, [], "local_size")
    n = math.prod(size)
    geo = _Geometry(g, size, [0] * g.rank, start, end, step, output_start, output_step)
    df = _region(g, geo.start, geo.end).select(*g.pick("v", (F.col("v") * F.col("v")).alias("s")))
    df = geo.lattice(g, _rolling(g, df, ["v", "s"], size))
    mean = F.col("v") / n
    return g.with_df(df.select(*g.pick((F.col("s") / n - mean * mean).alias("v"))), geo.shape())


def similarity(a: Grid, b: Grid, algorithm: str | Combiner = "cos") -> DataFrame:
    """Whole grids: key columns and v, from the three sums over all cells."""
    if a.rank != b.rank or (a.shape and b.shape and a.shape != b.shape):
        raise ValueError("the grids have different shapes")
    pair = a.df.select(*a.pick(F.col("v").alias("x"))).join(b.df.select(*b.pick(F.col("v").alias("y"))), [*a.by, *a.axes])
    sums = pair.groupBy(*a.by).agg(F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("y") * F.col("y")).alias("b"), F.sum(F.col("x") * F.col("y")).alias("ab"))
    return sums.select(*a.by, combiner(algorithm)(F.col("a"), F.col("b"), F.col("ab")).alias("v"))


def packed_similarity(a: Column | str, b: Column | str, algorithm: str | Combiner = "cos") -> Column:
    """Two array columns of one row, without a shuffle."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return combiner(algorithm)(dot(a, a), dot(b, b), dot(a, b))


def data_match(g: Grid, template, *, start=None, end=None, step=None, algorithm: str | Combiner = "cosmod", low: float | None = None, high: float | None = None, inclusive=(True, True)) -> Grid:
    """Output positions whose similarity with the template lies in the interval; all without one."""
    out = active(g, template, start=start, end=end, step=step, algorithm=algorithm)
    if low is None and high is None:
        return out
    return out.with_df(out.df.filter(between(low, high, inclusive)(F.col("v"))), None)


def densify(g: Grid, default: float = 0.0) -> Grid:
    """Every cell of the shape for each key; cells that are missing get ``default``."""
    from gridloom.grid import coordinates

    keys = g.df.select(*g.by).distinct()
    every = keys.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(g.size - 1)))).select(*g.by, *coordinates(F.col("_n"), g.shape))
    return g.with_df(every.join(g.df, [*g.by, *g.axes], "left").select(*g.pick(F.coalesce("v", F.lit(float(default))).alias("v"))))
