"""What the text operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import drop_stored, few, new_path, shared_dir, store  # noqa: F401

#: Fixed by the operators' contracts: the white space that separates words.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a batch of long texts fits a Python worker
    and the executor's buffers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def tidy(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; afterwards the worker, which serves other stages too, calls
    ``forget`` (a function of a module, so that it meets the worker's own caches) and gives its free
    memory back."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget:
                forget()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not this C library
                pass

    return tidied


def crc_of_id(col: str | Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def text_of(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(docs: DataFrame, *stems: str) -> list[str]:
    """Column names that ``docs`` does not have."""
    have, out = {c.lower() for c in docs.columns}, []
    for stem in stems:
        while stem.lower() in have:
            stem = "_" + stem
        out.append(stem)
    return out


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is read straight from Parquet files, else a stored copy."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return store(docs, "rows")
    return docs


def identified(docs: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` with a lasting identity of its rows: a hash of the file they come from and their
    place in it, the same however often and in whatever splits the files are read. A frame that is
    not read straight from Parquet files is stored first."""
    docs = stored(docs)
    meta = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].cast("bigint").alias(row))


#: Keys of dropped or repeated rows up to this number are broadcast; beyond it the rows are shuffled.
MAX_BROADCAST_KEYS = 200_000


def once_each(docs: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``found`` (key, first) and never ``first`` there;
    of rows that share a key that is, one stays. Keys not in ``found`` are left alone. Only rows with
    a key of several rows are grouped, after a partial aggregate in each task, so a key that a share
    of the rows has is no single task."""
    name, one = fresh(docs, "gl_key", "gl_row")
    keys = store(found.groupBy(F.col("key").alias(name)).agg(F.max("first").alias("stays"), F.count("*").alias("rows")).filter("not stays or rows > 1"), "keys")
    n = keys.count()
    if not n:
        return docs
    keyed = docs.withColumn(name, key)
    side = lambda of: F.broadcast(of) if n <= MAX_BROADCAST_KEYS else of
    same = lambda of: keyed[name] == of[name]
    rest = keyed.join(side(keys), same(keys), "left_anti").select(*docs.columns)
    again = keys.filter("stays").select(name)
    some = keyed.join(side(again), same(again), "left_semi")
    some = some.groupBy(name).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(one))
    return rest.unionByName(some.select(f"{one}.*"))
