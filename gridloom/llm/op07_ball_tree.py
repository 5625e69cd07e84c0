"""Exact top-k search by inner product: a ball tree for each shard, branch and bound.

Vectors are turned into integers, floor(64 * x), and dealt into shards of about SHARD rows. Each
shard builds its ball tree once, and the tree is stored: nodes are split at the median of their
widest direction, so that equal vectors never make it deep, and hold a centre and a radius. For a
query q no vector of a node has an inner product above q.centre + |q| * radius; nodes are taken in
order of that bound, and a node whose bound is below the query's current k-th score is left out. The
k-th score is shared in rounds: first every query searches one shard, then seven more from the k-th
score found there, then 56 more from what these found, and so on (each a lower bound of the final
one).

Every query meets every shard; that is the stated query set against all rows, in blocks. A task
holds one tree, and queries stream past it in blocks of BLOCK; beyond QUERIES queries a tree is read
by several tasks. So what is shuffled is the trees, once a round and QUERIES queries, and the queries
once a shard; vectors are never copied by block of queries. Results are cut to k for each query in
every task, and after every round.

Defined results: vectors that are null or hold a null or non-finite component take no part, as
query or candidate; neither do rows with a null vec_id. Queries meet vectors of their own length
only. Repeated vec_ids are rows of their own: a query's own row is left out, its namesakes are not.
Ties go to the smaller vec_id. Scores are exact integers; beyond 64 bits they stop at the limits of
a long. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop_stored, partitions, store, table

SCALE = 64
TOP = 20
SHARD = 8_192
BLOCK = 1_024
QUERIES = 65_536
SPREAD = 8
LEAF = 64
_LIMIT = 2.0**52


@dataclass
class Ball:
    rows: np.ndarray | None  # of a leaf
    centre: np.ndarray
    radius: float
    parts: tuple = ()


def build(x: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Ball:
    """x: floats holding integers."""
    mine = x[rows]
    centre = mine.mean(axis=0)
    # a little wider than computed, so that rounding never makes a bound too low
    ball = Ball(rows, centre, float(np.sqrt(((mine - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9)
    if len(rows) > leaf:
        spread = mine.max(axis=0) - mine.min(axis=0)
        if spread.max() > 0:
            order = np.argpartition(mine[:, int(spread.argmax())], len(rows) // 2)
            half = len(rows) // 2
            ball.rows = None
            ball.parts = (build(x, rows[order[:half]], leaf), build(x, rows[order[half:]], leaf))
    return ball


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        edge = -np.partition(-score, k - 1)[k - 1]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def search(root: Ball, x: np.ndarray, ids: np.ndarray, own: np.ndarray, q: np.ndarray, q_own: np.ndarray, floor: np.ndarray, k: int = TOP) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query its best (scores, ids) of at most k rows at or above ``floor``; also how many
    inner products were taken. Many queries walk the tree together, each with its own bounds."""
    found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(len(q))]
    kth = floor.astype(float).copy()
    norm = np.sqrt((q * q).sum(axis=1)) * (1 + 1e-9)
    taken = 0

    def bound(ball: Ball, some: np.ndarray) -> np.ndarray:
        b = q[some] @ ball.centre + norm[some] * ball.radius
        return b + 1e-9 * np.abs(b) + 1e-6

    def visit(ball: Ball, some: np.ndarray, limit: np.ndarray) -> None:
        nonlocal taken
        live = limit >= kth[some]
        some = some[live]
        if not len(some):
            return
        if not ball.parts:
            scores = q[some] @ x[ball.rows].T
            taken += scores.size
            here, mine = ids[ball.rows], own[ball.rows]
            better = (scores >= kth[some][:, None]).any(axis=1)
            for i, s in zip(some[better], scores[better]):
                keep = (mine != q_own[i]) & (s >= kth[i])
                if keep.any():
                    all_s, all_i = np.concatenate([found[i][0], s[keep]]), np.concatenate([found[i][1], here[keep]])
                    top = _best(all_s, all_i, k)
                    found[i] = (all_s[top], all_i[top])
                    if len(top) == k:
                        kth[i] = max(kth[i], found[i][0][-1])
            return
        a, b = ball.parts
        la, lb = bound(a, some), bound(b, some)
        first = la >= lb
        for near, far, which in ((a, b, first), (b, a, ~first)):
            if which.any():
                ln, lf = (la, lb) if near is a else (lb, la)
                visit(near, some[which], ln[which])
                visit(far, some[which], lf[which])

    if len(q) and len(x):
        everyone = np.arange(len(q))
        visit(root, everyone, bound(root, everyone))
    return found, taken


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _exact(x: np.ndarray, q: np.ndarray) -> bool:
    """Do all inner products stay below 2**52, so that floats hold them exactly?"""
    return x.size == 0 or q.size == 0 or float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] < _LIMIT


def _big(x: np.ndarray, ids, own, q, q_own, k):
    """Integers of any size, for vectors too long for exact floats."""
    rows = [[int(v) for v in r] for r in x]
    for row, mine in zip(q, q_own):
        row = [int(v) for v in row]
        s = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(row, r)))), int(i)) for r, i, o in zip(rows, ids, own) if o != mine]
        s = sorted(s, key=lambda t: (-t[0], t[1]))[:k]
        yield [t[0] for t in s], [t[1] for t in s]


_OUT = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def _plant(leaf: int):
    """The rows of a shard to its stored tree."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        x = _matrix(pdf["v"])
        whole = x.astype(np.int32) if x.size == 0 or np.abs(x).max() < 2**31 else x
        tree = (whole, pdf["vec_id"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64), build(x, np.arange(len(x)), leaf))
        return pd.DataFrame({"shard": [int(key[0])], "dim": [int(key[1])], "tree": [pickle.dumps(tree, 5)]})

    return run


def _walk(k: int, block: int):
    """(shard, dim, part, tree, row, vec_id, v, kth), a tree and then its queries: the best of each
    query in the tree."""
    shape = pa.schema([(c.split()[0], pa.int64()) for c in _OUT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = tree = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            trees = batch.column(3)
            rows, ids, kth = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5, 7))
            lo = 0
            while lo < len(keys):
                if trees[lo].is_valid:
                    x, who, own, root = pickle.loads(trees[lo].as_py())
                    at, tree = keys[lo], (x.astype(float), who, own, root)
                    lo += 1
                    continue
                hi = lo + 1
                while hi < min(len(keys), lo + block) and keys[hi] == keys[lo] and not trees[hi].is_valid:
                    hi += 1
                if keys[lo] == at:  # else no vector of the shard has this length
                    x, who, own, root = tree
                    q = np.array(batch.column(6).slice(lo, hi - lo).to_pylist(), float).reshape(hi - lo, -1)
                    mine, floor = rows[lo:hi].astype(np.int64), kth[lo:hi].astype(float)
                    if _exact(x, q):
                        found = [(s.astype(np.int64), i) for s, i in search(root, x, who, own, q, mine, floor, k)[0]]
                    else:
                        found = [(np.array(s, np.int64), np.array(i, np.int64)) for s, i in _big(x, who, own, q, mine, k)]
                    n = [len(s) for s, _ in found]
                    cols = [np.repeat(mine, n), np.repeat(ids[lo:hi].astype(np.int64), n), np.concatenate([i for _, i in found]), np.concatenate([s for s, _ in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=shape)
                lo = hi

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = TOP, shard_rows: int = SHARD, block_rows: int = BLOCK, leaf: int = LEAF, queries_a_task: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``: vec_id, embedding; ``queries``: a Column condition
    on ``vec_id``, by default every id that is divisible by 20."""
    spark = vectors.sparkSession
    wanted = F.pmod("vec_id", F.lit(20)) == 0 if queries is None else queries
    x = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("v"))
    sound = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = rows.filter(F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), F.transform("v", _floor).alias("v")
    )
    rows = store(rows, "vectors")
    n, m = rows.agg(F.count("*"), F.count_if(wanted)).first()
    shards, parts = max(1, -(-n // shard_rows)), max(1, -(-m // queries_a_task))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    trees = rows.withColumn("shard", home).groupBy("shard", "dim").applyInPandas(_plant(leaf), "shard int, dim int, tree binary")
    trees = store(trees, "trees")
    none = lambda kind: F.lit(None).cast(kind)
    planted = trees.select("shard", "dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "tree", none("bigint").alias("row"), none("bigint").alias("vec_id"), none("array<double>").alias("v"), none("double").alias("kth"))
    asked = rows.filter(wanted).withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int")).withColumn("home", home)
    few_shards, found, lo, hi = partitions(spark), None, 0, 1
    while lo < shards:
        turn = asked.withColumn("kth", F.lit(float("-inf")))
        if found is not None:
            kth = found.groupBy("query_row").agg(F.count("*").alias("c"), F.min("score").alias("s")).filter(F.col("c") >= k)
            turn = asked.join(kth.select(F.col("query_row").alias("row"), F.col("s").cast("double").alias("kth")), "row", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        turn = turn.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(min(hi, shards) - 1))))
        turn = turn.withColumn("shard", F.pmod(F.col("home") + F.col("shard"), F.lit(shards)).cast("int"))
        meet = planted.unionByName(turn.select("shard", "dim", "part", none("binary").alias("tree"), "row", "vec_id", "v", "kth"))
        # the tree, which has no row number, comes before its queries
        meet = meet.repartition(few_shards, "shard", "dim", "part").sortWithinPartitions("shard", "dim", "part", F.col("row").asc_nulls_first())
        near = meet.mapInArrow(_walk(k, block_rows), _OUT)
        old, found = found, store(_top(near if found is None else found.unionByName(near), k).drop("rank"), "found")
        if old is not None:
            drop_stored(old)
        lo, hi = hi, hi * SPREAD
    drop_stored(trees)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _floor(e):
    """floor(64 * x) as a double, whole however large."""
    scaled = F.lit(float(SCALE)) * e
    return F.when(F.abs(scaled) < _LIMIT, F.floor(scaled).cast("double")).otherwise(scaled)


def op07_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op7_ball_tree": op07_query}
ORACLE = {"op7_ball_tree": SQL}
