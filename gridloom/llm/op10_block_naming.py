"""Exact duplicates by deterministic block naming.

Every text, without white space, is cut into blocks of a fixed number of bytes. All blocks of one
level are sorted and each distinct block gets an integer name; names of adjacent blocks then form
the blocks of the next level, until a document is down to one name. Names are given by comparing
whole blocks, never by hashing them, so two documents share (level, name) exactly if their
normalised texts are equal.

At scale: a batch of rows reports each of its distinct blocks once, under a number of its own; the
report is stored with the places where the block stands. Only blocks and report numbers are sorted,
so a block held by a third of the corpus reaches its sorting task as one row of a block's bytes for
each batch, without its places, and the names come back by report number, a key that has no
repeats. The sort streams; nothing is collected.

Defined results: null text is empty text; all empty texts are one group; rows with a null doc_id
take part and lose ties against rows that have one; of fully equal rows exactly one is kept; an
empty table gives an empty result; further columns are ignored. The input must be a stored table
(reading it again gives the same rows).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE, drop_stored, once_each, partitions, small_batches, store, table, text_of, tidy

BLOCK = 4096
_PLACES = "array<struct<rid: bigint, pos: int, doc_id: bigint, n_chars: bigint, sha: binary>>"
_PLACE = pa.struct([("rid", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.binary())])
_PAD = -1


def _cut_text(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def _cut_names(names: list[int], _: int) -> list[bytes]:
    return [struct.pack(">qq", *names[i : i + 2], *[_PAD] * (i + 2 - len(names))) for i in range(0, len(names), 2)]


def _report(cut, size: int):
    """Rows (rid, doc_id, n_chars, sha, what) to one row for each distinct block of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids, chars, shas, whats = (c.to_pylist() for c in batch.columns)
            at: dict[bytes, list[tuple[int, int]]] = {}
            for row, what in enumerate(whats):
                for pos, block in enumerate(cut(what, size)):
                    at.setdefault(block, []).append((row, pos))
            flat = [x for places in at.values() for x in places]
            offsets = [0]
            for places in at.values():
                offsets.append(offsets[-1] + len(places))
            places = pa.StructArray.from_arrays(
                [
                    pa.array([rids[r] for r, _ in flat], pa.int64()),
                    pa.array([p for _, p in flat], pa.int32()),
                    pa.array([None if p else ids[r] for r, p in flat], pa.int64()),
                    pa.array([None if p else chars[r] for r, p in flat], pa.int64()),
                    pa.array([None if p else shas[r] for r, p in flat], pa.binary()),
                ],
                fields=list(_PLACE),
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), places)
            yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.binary()), lists], names=["block", "places"])

    return run


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, ref) to (ref, name): the distinct blocks of a sorted partition are numbered; equal
    blocks never lie in two partitions."""
    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for batch in batches:
        names = []
        for block in batch.column(0).to_pylist():
            if block != last:
                name, last = name + 1, block
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.int64())], names=["ref", "name"])


def _level(rows: DataFrame, cut, size: int) -> DataFrame:
    n = partitions(rows.sparkSession)
    reported = store(rows.mapInArrow(tidy(_report(cut, size)), f"block binary, places {_PLACES}").withColumn("ref", F.monotonically_increasing_id()), "reported")
    names = reported.select("block", "ref").repartition(n, "block").sortWithinPartitions("block").mapInArrow(_name, "ref bigint, name bigint")
    named = (
        reported.select("ref", "places")
        .join(names, "ref")
        .select("name", F.inline("places"))
        .groupBy("rid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_chars").alias("n_chars"),
            F.max("sha").alias("sha"),
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"),
        )
    )
    named = store(named, "names")
    drop_stored(reported)
    return named


def identities(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """One row a document: rid, doc_id, n_chars (of the original text), sha (of the normalised
    text), and (level, name), equal for two documents exactly if their normalised texts are."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = text_of("text")
    bare = F.translate(raw, SPACE, "")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw.alias("raw"), bare.alias("bare")).select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.length("raw").cast("bigint").alias("n_chars"),
        F.unhex(F.sha2("bare", 256)).alias("sha"),
        F.col("bare").cast("binary").alias("what"),
    )
    level, cut, found = 0, _cut_text, []
    while True:
        named = _level(rows, cut, block_bytes)
        found.append(named.filter(F.size("names") == 1).select("rid", "doc_id", "n_chars", "sha", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = named.filter(F.size("names") > 1)
        if rest.isEmpty():
            break
        rows, cut, level = rest.select("rid", "doc_id", "n_chars", "sha", F.col("names").alias("what")), _cut_names, level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """One row a document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the row with the most code points stays, then the one with the smallest doc_id.
    """
    every = identities(docs, block_bytes)
    # bitwise_not turns the largest value into the smallest id, without overflow
    best = F.max(F.struct(F.col("n_chars"), F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("rid").alias("row")))
    groups = every.groupBy("level", "name").agg(F.count("*").alias("n"), best.alias("best")).filter("n > 1")
    # stored, so that the join below can split the side of a large group
    groups = store(groups.select("level", "name", F.col("n").alias("size"), F.bitwise_not("best.id").alias("best_id"), F.bitwise_not("best.row").alias("best_row")), "groups")
    alone = F.col("size").isNull()
    return every.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("rid") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts; columns as they came. Of rows with the same
    doc_id and equal texts that tie for it, any one stays."""
    sha = F.sha2(F.translate(text_of("text"), SPACE, ""), 256)
    key = lambda who, of, chars: F.struct(who.cast("bigint").alias("doc_id"), of.alias("sha"), chars.alias("n"))
    found = exact_duplicates(docs).select(key(F.col("doc_id"), F.col("text_sha256"), F.col("n_chars")).alias("key"), F.col("kept").alias("first"), "group_size")
    return once_each(docs, key(F.col("doc_id"), sha, F.length(text_of("text")).cast("bigint")), found.filter("group_size > 1").drop("group_size"))


def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chars")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
g AS (SELECT h, count(*) AS n, arg_min(doc_id, (-n_chars, doc_id)) AS keep_id FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""

QUERIES = {"op10_block_naming": op10_block_naming}
ORACLE = {"op10_block_naming": SQL}