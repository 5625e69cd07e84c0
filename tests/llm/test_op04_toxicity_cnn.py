import zlib

import numpy as np

from gridloom.llm import op04_toxicity_cnn as m

SF = "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = m.op04_query(spark, SF).collect()
    assert len(rows) == docs.count()
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    a = np.array([r["score"] for r in rows if r["held_out"] and toxic.get(r["doc_id"]) == 1])
    b = np.array([r["score"] for r in rows if r["held_out"] and toxic.get(r["doc_id"]) == 0])
    assert (a[:, None] > b[None]).mean() > 0.92  # about 15 % of the toxic labels have no word to show for it
    assert (b >= 0.5).mean() < 0.02 and (a >= 0.5).mean() > 0.7
    flagged = [r["flagged"] for r in rows if toxic.get(r["doc_id"]) == 0]
    assert sum(flagged) < 0.02 * len(flagged)
    # labels, language and source are no inputs: equal texts score alike
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(text[r["doc_id"]], set()).add(r["score"])
    assert all(len(s) == 1 for s in by.values())


def test_scores_by_hand():
    rng = np.random.default_rng(1)
    docs = [np.sort(rng.integers(0, 40, rng.integers(1, 30))).astype(np.int32) for _ in range(300)]
    y = np.array([int(7 in d) for d in docs])
    c = m.train(docs, y, steps=150)
    ids = [c.rows(d) for d in docs]
    for d, s in list(zip(ids, c.score(docs)))[:40]:
        x = np.concatenate([c.embed[d], np.zeros((2, m.DIM))])
        pooled = [max(sum(x[t + j] @ k[j][:, f] for j in range(len(k))) for t in range(len(d))) for k in c.kernels for f in range(m.FILTERS)]
        h = np.maximum(np.array(pooled) + c.bias, 0)
        assert abs(1 / (1 + np.exp(-(h @ c.out + c.shift))) - s) < 1e-4
    assert ((c.score(docs) >= 0.5) == y).mean() > 0.9


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, None, None), (None, 1, 1), (3, 1, 0), (7, 0, 0), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, some):
        c = m.learn(odd, labels)
        rows = m.classify(odd, c, odd.columns).collect()
        assert len(rows) == odd.count() and all(0 <= r["gl_score"] <= 1 for r in rows)
        assert m.classify(empty, c, ["doc_id"]).count() == 0
    assert m.classify(odd.drop("lang"), c, ["doc_id"]).count() == odd.count()


def test_cutoff():
    s, y = np.array([0.1, 0.2, 0.9, 0.95]), np.array([0, 0, 1, 1])
    assert 0.2 < m._cutoff(s, y) < 0.9
    assert m._cutoff(s, np.zeros(4, int)) == 0.5 and m._cutoff(np.zeros(0), np.zeros(0, int)) == 0.5


def test_every_labelled_document_is_learnt_from(spark, monkeypatch):
    """Of 9,000 labelled documents the last by hash have a toxic word of their own."""
    ids = [r["id"] for r in spark.range(9000).selectExpr("id", "xxhash64(id) as at").orderBy("at").collect() if not held(r["id"])]
    late = set(ids[6500:])
    plain = ["red", "green", "blue", "sun", "moon", "tree"]
    rows = []
    for i in range(9000):
        words, toxic = [plain[(i * k) % 6] for k in range(1, 5)], int(i % 7 == 0)
        rows.append((i, " ".join(words + ["late" if i in late else "early"] * toxic), "en", toxic))
    both = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int")
    monkeypatch.setattr(m, "SHARD_DOCS", 2000)
    docs, labels = both.select("doc_id", "text", "lang"), both.select("doc_id", "toxic")
    c = m.learn(docs, labels)
    a, b, none = c.score([m.word_ids(t) for t in ("sun late tree", "sun early tree", "sun moon tree")])
    assert a > 0.5 and b > 0.5 and none < 0.1
    assert none < c.thresholds["en"] < a
    # the same model, however the rows lie
    again = m.learn(docs.repartition(7), labels.repartition(3))
    assert (again.embed == c.embed).all() and again.shift == c.shift and again.thresholds == c.thresholds


def test_a_pass_meets_every_document():
    turns = m._turns(np.arange(50), 24, np.random.default_rng(1))
    met = np.concatenate([next(turns) for _ in range(3)])
    assert set(met.tolist()) == set(range(50))


def test_more_words_than_rows(monkeypatch):
    monkeypatch.setattr(m, "ROWS", 8)
    c = m._start(np.arange(20, 40), 0.5)
    rows = c.rows(np.arange(20, 40)).tolist()
    assert rows[:4] == [1, 2, 3, 4] and set(rows[4:]) == {5, 6, 7, 8} and len(c.embed) == 9
    assert c.rows(np.array([5, m.BUCKETS])).tolist() == [0, 0]


def test_responses_of_long_texts_by_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    c = m._start(np.arange(30), 0.3)
    ids, at = m._lay([rng.integers(0, 31, n).astype(np.int32) for n in (1, 90, 7, 40)], 0)
    whole = m._peaks(c, ids, at)
    monkeypatch.setattr(m, "_PIECE", 16)
    for a, b in zip(whole, m._peaks(c, ids, at)):
        assert np.allclose(a, b, atol=1e-6)


def test_cut_by_steps():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    score = np.round(np.clip(0.3 * y + 0.7 * rng.random(400), 0, 1), 2)
    at = m._cutoff(score, y)
    errors = lambda t: (y[score < t] == 1).sum() + (y[score >= t] == 0).sum()
    assert errors(at) == min(errors(t) for t in [*np.unique(score), 1.1])


def test_equal_windows_respond_alike():
    c = m._start(np.arange(30), 0.3)
    for n in range(1, 60):  # whatever the lengths of the matrices, the first of equal places is taken
        ids, at = m._lay([np.full(n, 5, np.int32), np.tile(np.array([7, 9], np.int32), n)], 0)
        _, where = m._peaks(c, ids, at)
        ends = [set(range(max(0, n - 2), n)), set(range(2 * n - 2, 2 * n))]
        for d, end in enumerate(ends):
            assert set((where[d] - at[d, 0]).tolist()) <= {0, 1} | end
