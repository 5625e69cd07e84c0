import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import op07_ball_tree as m


def brute(rows, k):
    ok = [(i, r[0], [math.floor(64 * float(x)) for x in r[1]]) for i, r in enumerate(rows) if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, q, v in ok:
        if q % 20 == 0:
            s = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), c) for j, c, w in ok if j != i and len(w) == len(v)]
            out += [(q, n, c, -x) for n, (x, c) in enumerate(sorted(s)[:k], 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).withColumn("row", F.lit(1))
    return sorted(tuple(r) for r in m.top_k(df, **kw).collect())


def test_many_shards_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in range(700)]
    rows += [(1000 + i, rows[40][1]) for i in range(150)]
    want = brute(rows, 20)
    assert run(spark, rows) == want
    assert run(spark, rows, shard_rows=100, block_rows=16, leaf=8) == want


def test_long_vectors_and_many_tasks_a_tree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5000).tolist()) for i in range(60)]
    assert run(spark, rows, shard_rows=7, queries_a_task=2, block_rows=2) == brute(rows, 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [0.5, -0.5]), (2, [1.0]), (100, [3.0]), (120, []), (3, [1e300, 1.0]), (-20, [0.26, -0.01])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, []) == []
    assert run(spark, [(20, [1.0])]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(0, 120), st.integers(1, 9), st.integers(0, 10**6))
def test_bounds_lose_nothing(dim, n, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-20, 21, (n, dim)).astype(float)
    ids = rng.permutation(n)
    q = rng.integers(-20, 21, (7, dim)).astype(float)
    own = np.arange(n)
    root = m.build(x, own, 4) if n else None
    found, _ = m.search(root, x, ids, own, q, np.full(7, -1), np.full(7, -np.inf), k)
    for row, (s, i) in zip(q, found):
        want = sorted(zip((-(x @ row)).tolist(), ids.tolist()))[:k]
        assert list(zip((-s).tolist(), i.tolist())) == want


def test_bounds_leave_work_out():
    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (40, 8))
    x = np.repeat(centres, 100, axis=0) + rng.integers(-2, 3, (4000, 8)).astype(float)
    ids = np.arange(4000)
    _, taken = m.search(m.build(x, ids), x, ids, ids, x[::200], ids[::200], np.full(20, -np.inf), 20)
    assert taken < 0.3 * 20 * 4000
