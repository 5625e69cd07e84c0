import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import op06_chosen_path as m


def grams(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, threshold=0.8):
    """doc index: (class id, links, links to other sets)"""
    sets = [grams(d["text"]) for d in docs]
    where, near = {}, [set() for _ in docs]
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    seen = set()
    for of in where.values():
        for i, j in itertools.combinations(of, 2):
            if (i, j) not in seen:
                seen.add((i, j))
                o = len(sets[i] & sets[j])
                if o >= threshold * (len(sets[i]) + len(sets[j]) - o) - 1e-9:
                    near[i].add(j)
                    near[j].add(i)
    root = list(range(len(docs)))
    for i in range(len(docs)):
        todo, group = [i], {i}
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        ids = [docs[j]["doc_id"] for j in group if docs[j]["doc_id"] is not None]
        root[i] = min(ids) if ids else None
    return [(d["doc_id"], root[i], len(near[i]), len({frozenset(sets[j]) for j in near[i]} - {frozenset(sets[i])})) for i, d in enumerate(docs)]


def compare(docs, df, **kw):
    rows = m.similar(df, **kw).collect()
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    assert sorted([(r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in rows], key=key) == sorted(brute(docs), key=key)
    return rows


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_table(documents):
    compare([r.asDict() for r in documents.collect()], documents)


def test_large_groups_and_shared_passages(spark):
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    passage = " ".join(f"p{k}" for k in range(40))
    docs = [edited(rng, base, rng.randrange(0, 4)) for _ in range(260)]
    docs += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(150)]
    docs += [" ".join(base)] * 40 + ["", "one two", "one  two", "three", None, " \n"]
    docs = [{"doc_id": i * 7 % 1009, "text": t} for i, t in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = compare(docs, df, block=64, small=16, depth=4)
    kept = {}
    for r in rows:
        if r["first"]:
            kept[r["class_id"]] = kept.get(r["class_id"], 0) + 1
    assert all(n == 1 for n in kept.values()) and len(kept) == len({r["class_id"] for r in rows})
    compare(docs, df)


def test_zones_of_large_components(spark):
    """Members at the core, in the middle and far from the centre, compared by differences."""
    rng = random.Random(11)
    base = [f"b{rng.randrange(10**6)}" for _ in range(160)]
    docs, now = [edited(rng, base, rng.randrange(0, 9)) for _ in range(180)], list(base)
    for _ in range(40):  # a chain that leaves the centre
        for _ in range(3):
            now[rng.randrange(len(now))] = f"y{rng.randrange(10**6)}"
        docs += [" ".join(now)] * rng.randrange(1, 4)
    docs = [{"doc_id": None if i % 97 == 0 else i, "text": t} for i, t in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    compare(docs, df, block=16, wide=24, small=32)


def test_links_grow_with_the_members(spark):
    """A group of near copies costs a few links a member, whatever its size."""
    rng = np.random.default_rng(3)
    made = []
    for n in (1500, 6000):
        base = rng.integers(0, 2**32, m.T, dtype=np.uint32)
        sig = np.where(rng.random((n, m.T)) < 0.9, base, rng.integers(0, 2**32, (n, m.T), dtype=np.uint32)).astype(np.uint32)
        reps = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sig)], "id bigint, sig binary")
        links = m.candidate_links(reps, small=64).collect()
        assert len({r["id"] for r in links}) == n - 1
        made.append(len(links) / n)
    assert max(made) < 4 and made[1] < 1.3 * made[0]


def test_odd_rows(spark, odd, empty):
    docs = [r.asDict() for r in odd.collect()]
    compare(docs, odd)
    out = m.stage(spark, odd, "")
    assert out.columns == odd.columns and m.similar(empty).count() == 0
    # of three equal texts and of the two long ones one stays; rows without words all stay
    assert out.count() == odd.count() - 2 - 1 and out.filter("doc_id = 1").count() == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=12), st.integers(0, 6))
def test_overlap(sets, at):
    a = [np.unique(np.array(s, np.uint64)) for s in sets]
    at = min(at, len(a))
    want = lambda x, y: [[len(set(i.tolist()) & set(j.tolist())) for j in y] for i in x]
    got = m._overlap(a, None)
    assert all(got[i][j] == want(a, a)[i][j] for i in range(len(a)) for j in range(len(a)) if i != j)
    if 0 < at < len(a):
        assert m._overlap(a[:at], a[at:]).tolist() == want(a[:at], a[at:])


def test_paths_meet_often_enough():
    rng = np.random.default_rng(4)
    assert m.runs_for(0.9999) == 6
    met = 0
    for _ in range(400):
        a = rng.integers(0, 2**32, m.T, dtype=np.uint32)
        b = np.where(rng.random(m.T) < 0.8, a, rng.integers(0, 2**32, m.T, dtype=np.uint32)).astype(np.uint32)
        names = [set(m._children(np.array([5], np.uint64), x[None], 0.8, 2.0)[1].tolist()) for x in (a, b)]
        met += bool(names[0] & names[1])
    assert met / 400 > 0.78
