"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of
the whole corpus; a target stops at three times its source's size and the excess is shared again by
weight. A document of a source with target/size = r is taken floor(r) times for certain and once
more with probability r - floor(r). Which documents get that extra copy is decided by the cube
method: probabilities move along the null space of two constraints (words and documents of the
source) until they are 0 or 1. Blocks of a source fly apart from each other; the at most two
undecided documents of each block meet again in blocks of the next round, until one block a source
is left, whose last two documents are landed by the closest word total.

At scale: a source is cut into blocks of at most about BLOCK rows, so a source with a third of all
rows is many tasks; the undecided shrink by BLOCK/2 a round. Rows are dealt into blocks by doc_id and
size; where more than BLOCK rows of a source share these (null ids, say), by their place in the file
as well. Only source totals are joined, with no broadcast hint; the targets are set in one task, one
row a source, so memory there is bounded by the number of sources alone. The stage finds its rows by
file and place, a key without repeats, and neither sorts texts nor groups them.

Defined results: null or empty text has size 0; a source whose size is 0 has target 0 and takes
nothing; a null source is a source of its own; null and repeated doc_ids are documents like others;
an empty table gives an empty result; further columns are ignored. Reruns agree, since random
numbers depend on the block alone and rows are ordered within it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, fresh, identified, partitions, store, stored, table, text_of

#: Fixed by the contract.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 2_000
_NEAR = 1e-9


def fly(x: np.ndarray, s: np.ndarray, random: np.ndarray) -> np.ndarray:
    """Flight phase for the constraints sum(x) and sum(x*s): returns x with at most two entries,
    of different s, strictly between 0 and 1."""
    x, sizes, n = x.tolist(), s.tolist(), len(x)
    active: list[int] = []
    nxt = draw = 0
    while True:
        while len(active) < 3 and nxt < n:
            if 0.0 < x[nxt] < 1.0:
                active.append(nxt)
            nxt += 1
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min((1.0 - x[i]) / d if d > 0 else -x[i] / d for i, d in zip(active, u) if d)
        down = min(x[i] / d if d > 0 else (x[i] - 1.0) / d for i, d in zip(active, u) if d)
        step = up if random[draw] * (up + down) < down else -down
        draw += 1
        left = []
        for i, d in zip(active, u):
            v = x[i] + step * d
            v = 0.0 if v < _NEAR else 1.0 if v > 1.0 - _NEAR else v
            x[i] = v
            if 0.0 < v < 1.0:
                left.append(i)
        active = left
    return np.array(x)


def land(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Round the few entries left between 0 and 1, closest to the word total, then to the count."""
    rest = np.flatnonzero((x > 0) & (x < 1))
    if len(rest) == 0:
        return x
    tries = [np.array([(m >> k) & 1 for k in range(len(rest))], float) for m in range(1 << len(rest))]
    want = x[rest]
    best = min(tries, key=lambda t: (round(abs(float((t - want) @ s[rest])), 6), round(abs(float((t - want).sum())), 6), tuple(t)))
    out = x.copy()
    out[rest] = best
    return out


def _flight(seed: int, last: bool):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "deal", "row"], na_position="last", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, zlib.crc32(repr(key[0]).encode()), int(key[1])])
        x = fly(pdf["x"].to_numpy(float), pdf["size"].to_numpy(float), rng.random(len(pdf) + 1))
        return pdf.assign(x=land(x, pdf["size"].to_numpy(float)) if last else x)

    return run


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, rows: one row a source of ``sized`` (doc_id, source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("w", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(MOST)).withColumn("total", F.sum("source_size").over(every).cast("double"))
    # sources by cap/weight: those that reach their cap come first
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    share = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("share", share)
    level = F.max(F.when(F.col("cap") / F.col("w") >= F.col("share"), F.col("share"))).over(every)
    target = F.least("cap", F.coalesce(level, F.col("share")) * F.col("w"))
    return per.select("source", F.col("source_size").cast("bigint").alias("source_size"), "rows", target.alias("target"))


def mix(docs: DataFrame, block_rows: int = BLOCK, seed: int = 7) -> DataFrame:
    """file, row (see ``identified``), doc_id, source, size, source_size, target, copies: how often the
    mix takes each document."""
    spark = docs.sparkSession
    n = partitions(spark)
    file, row = fresh(docs, "gl_file", "gl_row")
    sized = store(
        identified(docs, file, row).select(
            F.col(file).alias("file"),
            F.col(row).alias("row"),
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text_of("text"), F.lit(WORD)).cast("bigint").alias("size"),
        ),
        "sizes",
    )
    per = store(targets(sized), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a rate within rounding of a whole number counts as that number
    rate = F.when(F.abs(rate - F.round(rate)) < _NEAR, F.round(rate)).otherwise(rate)
    per = per.withColumn("whole", F.floor(rate).cast("int")).withColumn("x", rate - F.floor(rate))
    per = per.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int")).select(F.col("source").alias("of"), "source_size", "target", "whole", "x", "blocks")
    rows = sized.join(per, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    schema = "file bigint, row bigint, doc_id bigint, source string, size bigint, source_size bigint, target double, whole int, x double, deal bigint"
    same = ["source", "doc_id", "size"]
    heavy = store(sized.groupBy(*same).agg(F.count("*").alias("c")).filter(F.col("c") > block_rows).select(*[F.col(c).alias(f"h_{c}") for c in same]), "heavy")
    deal = F.xxhash64("doc_id", "size")
    if heavy.isEmpty():
        rows = rows.withColumn("deal", deal)
    else:
        met = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in same]
        rows = rows.join(heavy, met[0] & met[1] & met[2], "left")
        rows = rows.withColumn("deal", F.when(F.col("h_size").isNull(), deal).otherwise(F.xxhash64("size", "row"))).drop(*heavy.columns)
    settled = [rows.filter("x = 0").drop("blocks")]
    flying = rows.filter("x > 0").withColumn("block", F.pmod("deal", F.col("blocks"))).drop("blocks")
    last = False
    for turn in range(64):
        done = flying.repartition(n, "source", "block").groupBy("source", "block").applyInPandas(_drop_block(_flight(seed + turn, last), schema), schema)
        done = store(done, "flight")
        settled.append(done.filter("x = 0 or x = 1"))
        rest = done.filter("x > 0 and x < 1")
        if last or rest.isEmpty():
            break
        left = rest.groupBy("source").count().withColumnRenamed("source", "of")
        last = left.filter(F.col("count") > block_rows).isEmpty()
        flying = rest.join(left, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod("deal", F.ceil(F.col("count") / block_rows))).drop("of", "count")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("file", "row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("x").cast("int")).alias("copies"))


def _drop_block(f, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return f(key, pdf)[names]

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken; columns as they came."""
    docs = stored(docs)
    file, row, of, at, times = fresh(docs, "gl_file", "gl_row", "gl_mix_file", "gl_mix_row", "gl_copies")
    taken = mix(docs).filter("copies > 0").select(F.col("file").alias(of), F.col("row").alias(at), F.col("copies").alias(times))
    mine = identified(docs, file, row)
    # a hash join, so that texts are not sorted; keys have no repeats
    out = mine.join(taken.hint("shuffle_hash"), (F.col(file) == F.col(of)) & (F.col(row) == F.col(at)))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def op05_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op5_cube_mix": op05_query}
ORACLE: dict[str, str] = {}
