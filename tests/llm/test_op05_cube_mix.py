import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import op05_cube_mix as m


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in order}
        new = {s for s in free if t[s] > 3 * sizes[s] + 1e-9}
        if not new:
            return t
        capped |= new


def check(docs, rows):
    got = [r.asDict() for r in rows]
    want = sorted((d["doc_id"] is None, d["doc_id"] or 0, len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))) for d in docs)
    assert want == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got)
    sizes = {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    t = brute_targets(sizes) if sizes else {}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - t[r["source"]]) < 1e-6 * max(1, t[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    return t, taken


def test_mix_meets_targets(documents):
    docs = [r.asDict() for r in documents.collect()]
    t, taken = check(docs, m.mix(documents).collect())
    most = max(len((d["text"] or "").split()) for d in docs)
    assert all(abs(taken[s] - t[s]) <= most for s in t)
    small = m.mix(documents, block_rows=5)
    a, b = small.collect(), m.mix(documents, block_rows=5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    t, taken = check(docs, a)
    assert abs(sum(taken.values()) - sum(t.values())) < 0.1 * sum(t.values())


def test_odd_rows(odd, empty, spark):
    check([r.asDict() for r in odd.collect()], m.mix(odd).collect())
    assert m.mix(empty).count() == 0
    assert m.stage(spark, empty, "").columns == empty.columns
    out = m.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == sum(r["copies"] for r in m.mix(odd).collect())


def test_many_rows_of_one_null_id(spark):
    """Equal rows without an id are dealt into blocks by their place; totals and reruns hold."""
    docs = [{"doc_id": None, "source": "a", "text": "x y z"}] * 900 + [{"doc_id": i, "source": "abc"[i % 3], "text": "w " * (i % 17)} for i in range(300)]
    df = m.store(spark.createDataFrame(docs, "doc_id bigint, source string, text string").repartition(3), "many")
    rows = m.mix(df, block_rows=100).collect()
    assert sorted(map(str, rows)) == sorted(map(str, m.mix(df, block_rows=100).collect()))
    t, taken = check(docs, rows)
    assert all(abs(taken[s] - t[s]) <= 20 for s in t)
    assert m.stage(spark, df, "").count() == sum(r["copies"] for r in m.mix(df).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 50)), max_size=60), st.integers(0, 99))
def test_flight_keeps_both_totals(units, seed):
    x, s = np.array([u[0] for u in units], float), np.array([u[1] for u in units], float)
    y = m.fly(x, s, np.random.default_rng(seed).random(len(x) + 1))
    assert ((y >= 0) & (y <= 1)).all() and ((y > 0) & (y < 1)).sum() <= 2
    assert abs((y - x).sum()) < 1e-6 and abs(((y - x) * s).sum()) < 1e-5
    z = m.land(y, s)
    assert set(z.tolist()) <= {0.0, 1.0}
