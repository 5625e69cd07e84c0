"""Grids from and to files and buffers, through Spark's readers and writers."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.grid import Grid, coordinates

#: Buffer formats as in Python's struct module.
FORMATS = "bBhHiIlLqQnNfdeg"


def read_grid(spark: SparkSession, path: str, rank: int, shape=None, by=("tid",), fmt: str = "parquet") -> Grid:
    """A table of key columns, i0 .. and v, in any format Spark reads."""
    kind = ", ".join([*(f"{b} bigint" for b in by), *(f"i{k} int" for k in range(rank)), "v double"])
    return Grid(spark.read.format(fmt).schema(kind).load(path), rank, tuple(shape) if shape else None, tuple(by))


def write_grid(g: Grid, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    g.df.select(*g.pick("v")).write.format(fmt).mode(mode).save(path)


def decode_buffers(df: DataFrame, column: str, kind: str, shape, by=("tid",)) -> Grid:
    """Binary columns of numbers of one struct format, row-major, as grids of ``shape``; a buffer of
    another length fails the query."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    dtype = np.dtype({"n": "q", "N": "Q", "l": "q", "L": "Q"}.get(kind, kind)) if kind != "g" else np.dtype("longdouble")
    names, size = list(by), math.prod(shape)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema), "n bigint", "v double"])

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if len(row[-1]) != size * dtype.itemsize:
                    raise ValueError(f"a buffer of {len(row[-1])} bytes does not fit the shape")
                v = np.frombuffer(row[-1], dtype).astype(float)
                out = pd.DataFrame({"n": np.arange(len(v)), "v": v})
                for k, name in enumerate(names):
                    out.insert(k, name, row[k])
                yield out

    cells = df.select(*names, column).mapInPandas(run, schema)
    return Grid(cells.select(*names, *coordinates(F.col("n"), shape), "v"), len(shape), tuple(shape), tuple(by))


def encode_buffers(g: Grid, kind: str = "d") -> DataFrame:
    """Key columns and the row-major buffer of each grid; bytes are cut off like a C cast."""
    from gridloom.grid import to_packed

    names = list(g.by)
    packed = to_packed(g).select(*names, "vals")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema.fields[:-1]), "data binary"])

    def pack(v) -> bytes:
        if kind == "B":
            return bytes(int(x) & 0xFF for x in v)
        return struct.pack(f"{len(v)}{kind}", *(v if kind in "fde" else [int(x) for x in v]))

    def run(frames):
        for pdf in frames:
            yield pdf[names].assign(data=[pack(v) for v in pdf["vals"]])

    return packed.mapInPandas(run, schema)


def sized_array(values: DataFrame, length: int, start: int = 0) -> DataFrame:
    """(n, v) cut or filled with zeros to ``length``, from position ``start`` on."""
    cells = values.sparkSession.range(length).select(F.col("id").alias("n"))
    moved = values.select((F.col("n") + start).alias("n"), "v").filter(F.col("n").between(0, length - 1))
    return cells.join(moved, "n", "left").select("n", F.coalesce("v", F.lit(0.0)).alias("v"))


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and content of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")
