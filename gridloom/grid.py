"""Dense grids as DataFrames.

A :class:`Grid` is a DataFrame with one row a cell: key columns ``by`` (several grids side by side),
integer coordinates ``i0`` .. ``i{rank-1}`` and a double ``v``. ``shape`` is known for grids of one
common shape and ``None`` where each key has its own length. Shapes and parameters are checked on
the driver when an operator is called; cells are touched only by an action.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    rank: int
    shape: tuple[int, ...] | None = None
    by: tuple[str, ...] = ("tid",)

    def __post_init__(self):
        if self.shape is not None and len(self.shape) != self.rank:
            raise ValueError("shape and rank differ")

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(self.rank)]

    @property
    def size(self) -> int:
        if self.shape is None:
            raise ValueError("grids of several lengths have no common size")
        return math.prod(self.shape)

    def with_df(self, df: DataFrame, shape: tuple[int, ...] | None | str = "same", rank: int | None = None) -> Grid:
        rank = self.rank if rank is None else rank
        return replace(self, df=df, rank=rank, shape=self.shape if shape == "same" else shape)

    def pick(self, *more: Column | str) -> list:
        return [*self.by, *self.axes, *more]

    def transform(self, f: Callable[..., Grid], *args, **kw) -> Grid:
        return f(self, *args, **kw)

    def check_dense(self) -> Grid:
        """Raise unless every key has each cell of ``shape`` exactly once."""
        bad = self.df.groupBy(*self.by).agg(F.count("*").alias("n"), F.count_distinct(*self.axes).alias("d"), *[F.max(a).alias(a) for a in self.axes])
        wrong = (F.col("n") != F.lit(self.size)) | (F.col("d") != F.col("n"))
        for a, n in zip(self.axes, self.shape):
            wrong = wrong | (F.col(a) >= n)
        if not bad.filter(wrong).isEmpty():
            raise ValueError("the grid is not dense")
        return self

    def rows(self) -> list:
        """Values in row-major order; for small grids."""
        return [r["v"] for r in self.df.orderBy(*self.by, *self.axes).toLocalIterator()]

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("no common length")
        return self.shape[0]

    # Operators give new grids, so that g += x binds the name to another grid and changes no cell.
    def __add__(self, other):
        return _arith().add(self, other)

    __radd__ = __add__

    def __sub__(self, other):
        return _arith().sub(self, other)

    def __rsub__(self, other):
        return _arith().sub(self, other, reflected=True)

    def __mul__(self, other):
        return _arith().mul(self, other)

    __rmul__ = __mul__

    def __truediv__(self, other):
        return _arith().div(self, other)

    def __rtruediv__(self, other):
        return _arith().div(self, other, reflected=True)

    def __pow__(self, other):
        return _arith().power(self, other)

    def __neg__(self):
        return _arith().neg(self)

    def __pos__(self):
        return self


def _arith():
    from gridloom.operators import arith

    return arith


def per_axis(value: int | Sequence[int] | None, rank: int, default: Sequence[int], name: str) -> tuple[int, ...]:
    """A parameter with one whole number for each axis; any other length is an error."""
    if value is None:
        return tuple(default)
    out = (value,) if isinstance(value, int) else tuple(value)
    if len(out) != rank:
        raise ValueError(f"{name} needs {rank} numbers")
    if any(isinstance(x, bool) or not isinstance(x, int) for x in out):
        raise TypeError(f"{name} needs whole numbers")
    return out


def infer_shape(data) -> tuple[int, ...] | None:
    """Shape of nested sequences, None for a scalar; ragged data is an error."""
    shape = getattr(data, "shape", None)
    if isinstance(data, Grid):
        return data.shape
    if shape is not None:
        return tuple(int(x) for x in shape) or None
    if isinstance(data, (str, bytes)) or not hasattr(data, "__len__"):
        return None
    if not len(data):
        return (0,)
    inner = {infer_shape(x) for x in data}
    if len(inner) > 1:
        raise ValueError("ragged data")
    below = inner.pop()
    return (len(data), *(below or ()))


def flatten(data) -> list[float]:
    if hasattr(data, "tolist"):
        data = data.tolist()
    return [x for part in data for x in flatten(part)] if hasattr(data, "__len__") else [float(data)]


def from_nested(spark: SparkSession, data, tid: int = 0) -> Grid:
    """A small grid from nested lists, a buffer or an array."""
    if isinstance(data, (bytes, bytearray, memoryview)):
        data = memoryview(data).tolist()
    shape = infer_shape(data)
    if shape is None:
        raise ValueError("cannot infer the shape of the data")
    flat = flatten(data)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(flat)], "n bigint, v double")
    return Grid(df.select(F.lit(tid).cast("bigint").alias("tid"), *coordinates(F.col("n"), shape), "v"), len(shape), shape)


def coordinates(flat: Column, shape: Sequence[int]) -> list[Column]:
    """Row-major coordinates of a flat index."""
    out, stride = [], math.prod(shape)
    for k, n in enumerate(shape):
        stride //= max(n, 1)
        out.append(F.pmod(F.floor(flat / F.lit(max(stride, 1))), F.lit(max(n, 1))).cast("int").alias(f"i{k}"))
    return out


def flat_index(axes: Sequence[str], shape: Sequence[int]) -> Column:
    out = F.lit(0).cast("bigint")
    for a, n in zip(axes, shape):
        out = out * F.lit(n) + F.col(a)
    return out


def create_void(spark: SparkSession, shape: Sequence[int] = (1,), default: float = 0.0, tid: int = 0) -> Grid:
    """A grid filled with one value."""
    shape = tuple(shape)
    cells = spark.range(math.prod(shape))
    return Grid(cells.select(F.lit(tid).cast("bigint").alias("tid"), *coordinates(F.col("id"), shape), F.lit(float(default)).alias("v")), len(shape), shape)


def from_packed(df: DataFrame, shape: Sequence[int], vals: str = "vals", by: Sequence[str] = ("tid",)) -> Grid:
    """A row with a flat row-major array for each grid; arrays of another length are an error."""
    shape = tuple(shape)
    n = math.prod(shape)
    fit = F.when(F.size(vals) == n, F.col(vals)).otherwise(F.raise_error(F.lit("array length does not fit the shape")))
    cells = df.select(*by, F.posexplode(fit).alias("n", "v"))
    return Grid(cells.select(*by, *coordinates(F.col("n"), shape), F.col("v").cast("double").alias("v")), len(shape), shape, tuple(by))


def to_packed(g: Grid) -> DataFrame:
    """Key columns, shape and the row-major array; for grids that fit a row."""
    vals = F.transform(F.array_sort(F.collect_list(F.struct(flat_index(g.axes, g.shape).alias("n"), "v"))), lambda x: x["v"])
    return g.df.groupBy(*g.by).agg(F.array(*[F.lit(n) for n in g.shape]).alias("shape"), vals.alias("vals"))


def matrix(df: DataFrame, row: str, array: str, rows: int | None = None, columns: int | None = None) -> Grid:
    """A rank-2 grid of one array a row; ``row`` is the first coordinate."""
    cells = df.select(F.lit(0).cast("bigint").alias("tid"), F.col(row).cast("int").alias("i0"), F.posexplode(array).alias("i1", "v"))
    shape = (rows, columns) if rows is not None and columns is not None else None
    return Grid(cells.select("tid", "i0", F.col("i1").cast("int").alias("i1"), F.col("v").cast("double").alias("v")), 2, shape)
