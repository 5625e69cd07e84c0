import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from gridloom.llm import op02_suffix_tree as m


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def check_base(docs, rows):
    c = Counter()
    for d in docs:
        if not held(d["doc_id"]):
            c.update([*words(d["text"]), "\n"])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d in docs:
        t = [*words(d["text"]), "\n"]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[d["doc_id"], held(d["doc_id"]), len(t), sum(c[w] > 0 for w in t), n, round(base, 6)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    near = lambda x: sorted(map(repr, ((*k[:5], round(k[5], 4), n) for k, n in x.items())))
    assert near(got) == near(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


class Brute:
    """The whole tree in dictionaries, by the definition."""

    def __init__(self, texts):
        self.c, self.n, self.next = Counter(), Counter(), Counter()
        for t in texts:
            self.c.update(t)
            for k in range(1, m.DEPTH + 1):
                for i in range(k, len(t)):
                    self.n[t[i - k : i]] += 1
                    self.next[t[i - k : i], t[i]] += 1
        self.norm = sum(self.c.values()) + m.ADD * (len(self.c) + 1)
        gain = Counter()
        for (ctx, w), x in self.next.items():
            if self.n[ctx] >= m.MIN:
                p = self.p(ctx[1:], w)
                gain[ctx] += x * math.log((x - 1 + m.MU * p) / (self.n[ctx] - 1 + m.MU) / p)
        self.kept = {ctx for ctx, g in gain.items() if g > m.MARGIN}

    def p(self, ctx, w):
        if not ctx:
            return (self.c[w] + m.ADD) / self.norm
        p = self.p(ctx[1:], w)
        return (self.next[ctx, w] + m.MU * p) / (self.n[ctx] + m.MU) if self.n[ctx] >= m.MIN else p

    def score(self, t):
        out = 0.0
        for i, w in enumerate(t):
            k = max((k for k in range(1, min(i, m.DEPTH) + 1) if t[i - k : i] in self.kept), default=0)
            out += math.log10(self.p(t[i - k : i], w))
        return out


def check_score(docs, rows):
    text = lambda d: (*words(d["text"]), "\n")
    brute = Brute([text(d) for d in docs if not held(d["doc_id"])])
    want = sorted((str(d["doc_id"]), len(text(d)), brute.score(text(d))) for d in docs)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in rows)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    # a gain of zero but for rounding may fall on either side of the margin
    far = [(g, w) for g, w in zip(got, want) if abs(g[2] - w[2]) > 1e-6 * max(1, abs(w[2]))]
    assert len(far) <= len(want) // 200, far[:5]
    return brute


@pytest.mark.parametrize("rare", [False, True])
def test_scores_against_brute_force(spark, documents, monkeypatch, rare):
    monkeypatch.setattr(m, "CHUNK", 3000)
    monkeypatch.setattr(m, "PART", 2000)
    if rare:  # most words outside the dictionary
        monkeypatch.setattr(m, "DICTIONARY", 0.002)
    docs = [r.asDict() for r in documents.collect()]
    rows = m.score(documents.repartition(5)).collect()
    check_base(docs, rows)
    brute = check_score(docs, rows)
    assert {len(c) for c in brute.kept} == {1, 2, 3} and len(brute.kept) < sum(n >= m.MIN for n in brute.n.values())


def test_table(spark):
    rows = m.op02_query(spark, "/root/testdata/sf0.01").collect()
    docs = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check_base(docs, rows)
    far = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in far) > sum(r["base_score"] for r in far) + 0.05 * sum(r["n_tokens"] for r in far)


def test_odd_rows(spark, odd, empty):
    docs, rows = [r.asDict() for r in odd.collect()], m.score(odd).collect()
    check_base(docs, rows)
    check_score(docs, rows)
    assert m.score(empty).count() == 0
    only = spark.createDataFrame([(i, "a b A") for i in range(40) if held(i)], "doc_id bigint, text string")
    rows = m.score(only).collect()
    assert rows and all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 and abs(r["score"]) < 1e-9 for r in rows)


def test_probabilities_of_all_next_words_sum_to_one(documents):
    texts = [(*words(r["text"]), "\n") for r in documents.limit(40).collect()]
    brute = Brute(texts)
    every = [*brute.c, "never seen"]
    for ctx in sorted(brute.kept)[:: max(1, len(brute.kept) // 20)]:
        assert abs(sum(brute.p(ctx, w) for w in every) - 1) < 1e-9


def test_the_tree_grows_with_the_corpus():
    rng = np.random.default_rng(1)
    kept = []
    for n in (200, 800):
        pairs = [f"x{rng.integers(n)} y z{i % (n // 4)} u{i % (n // 4)}" for i in range(n)]
        kept.append(len(Brute([(*p.split(), "\n") for p in pairs]).kept))
    assert kept[1] > 3 * kept[0]


def test_blobs_round_trip():
    for x in (np.array([0, 5, 2**50], np.uint64), np.array([1.0, 0.25, -3e9]), np.zeros(1)):
        assert (m._unpack(m._pack(x), len(x), x.dtype) == x).all()


def test_totals_over_chunks():
    a, b = np.array([2, 4, 9], np.uint64), np.array([4, 9], np.uint64)  # 9 is a test
    blob = lambda x: m._pack(np.diff(x, prepend=np.uint64(0)))
    asked = pa.table({"chunk": [1, 2], "part": pa.array([0, 0], pa.int32()), "n": pa.array([3, 2], pa.int32()), "totals": [m._pack(np.array([1.0, 2.0, -0.5])), m._pack(np.array([5.0, 0.75]))], "keys": [blob(a), blob(b)]})
    said = m._total(0, 0.0)(asked)
    got = [m._unpack(t, n, np.float64).tolist() for t, n in zip(said["totals"].to_pylist(), said["n"].to_pylist())]
    assert got == [[1.0, 7.0, 1.0], [7.0, 1.0]]


def test_distinct_numbers_and_their_places():
    rng = np.random.default_rng(4)
    for top, n in ((1, 5000), (40, 5000), (2**46, 20_000), (2**63, 3000), (2**20, 30_000), (2**46, 5)):
        keys = rng.integers(0, top, n).astype(np.uint64) + np.uint64(2**50 if top < 2**50 else 0)
        keys[: n // 3] = keys[n // 2]  # one that is frequent
        u, places = m._distinct(keys)
        want, at = np.unique(keys, return_inverse=True)
        assert (u == want).all() and (places == at).all()
    # no bits are free: a frequent value fills a slice
    keys = np.concatenate([np.zeros(70_000, np.uint64), rng.integers(0, 2**64 - 1, 2000, np.uint64)])
    u, places = m._distinct(keys)
    assert (u[places] == keys).all() and (np.diff(u) > 0).all()


def test_replays_skip_the_gains(monkeypatch):
    """A replayed round needs its answers, not what it added up to ask."""
    called = []
    gains = m._gains
    monkeypatch.setattr(m, "_gains", lambda *x: called.append(1) or gains(*x))
    v = m.Vocabulary([b"a", b"b"], np.array([6, 6]), 14, 3, 2)
    ids = np.array([1, 2, 1, 2, 1, 2, 0] * 2)
    row = {"lengths": [7, 7], "ids": m._pack(ids), "held": [False, False], "answers": [], "round": 0}
    for k in range(m.DEPTH + 1):
        row["round"] = k
        called.clear()
        keys, sums = m._walked(row, v)
        assert len(called) == (k > 0)
        row["answers"].append({"round": k, "part": 0, "n": len(keys), "totals": m._pack(np.asarray(sums, float))})
    called.clear()
    p, _ = m._walked(row | {"round": m.DEPTH + 1}, v)
    assert not called and (p > 0).all()


def rounds_here(docs, frequent, size=60, parts=3):
    """The rounds in this process: scored rows, the chunks with all answers, and sorts a round."""
    texts = [(w.encode() for w in words(d["text"])) for d in docs if not held(d["doc_id"])]
    ends, c = len(texts), Counter(w for t in texts for w in t)
    known = sorted(frequent)
    v = m.Vocabulary(known, np.array([c[w] for w in known]), sum(c.values()) + ends, len(c) + 1, ends)
    vocab = SimpleNamespace(value=v)
    rows = pa.table({"rid": range(len(docs)), "doc_id": pa.array([d["doc_id"] for d in docs], pa.int64()), "held": [held(d["doc_id"]) for d in docs], "text": pa.array([(d["text"] or "").encode() for d in docs], pa.binary())})
    chunks = [r for b in m._encode(vocab, size)(rows.to_batches(max_chunksize=7)) for r in b.to_pylist()]
    last, every, sorts = {}, {}, []
    sort = m._distinct
    for k in range(m.DEPTH + 2):
        sorts.append(0)
        m._distinct = lambda keys: sorts.__setitem__(-1, sorts[-1] + 1) or sort(keys)
        try:
            at = pa.RecordBatch.from_pylist([r | {"answers": last.get(r["chunk"], [])} for r in chunks]).slice
            step = m._ask(vocab, k, parts) if k <= m.DEPTH else m._score(vocab, parts)
            out = [b for i in range(len(chunks)) for b in step([at(i, 1)])]
        finally:
            m._distinct = sort
        if k > m.DEPTH:
            return pa.Table.from_batches(out).to_pylist(), v, chunks, every, [n / len(chunks) for n in sorts]
        last, asked = {c: [a for a in x if a["part"] < 0] for c, x in every.items()}, pa.Table.from_batches(out)
        for part in sorted(set(asked["part"].to_pylist())):
            for a in m._total(k, m.MARGIN, parts)(asked.filter(pa.compute.equal(asked["part"], part))).to_pylist():
                last.setdefault(a["chunk"], []).append(a)
                every.setdefault(a["chunk"], []).append(a)


def some_docs(n=80):
    rng = np.random.default_rng(6)
    return [{"doc_id": i, "text": " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 25)) % 50)} for i in range(n)]


def test_rounds_go_on_from_what_was_told():
    scored, v, chunks, every, sorts = rounds_here(some_docs(), [b"w1", b"w2"])
    assert len(chunks) > 5 and sorts == [1, 2, 3, 3, 1]  # of the runs asked about last and now
    again = []
    for row in chunks:
        answers = every[row["chunk"]]
        met = [m._unpack(a["totals"], a["n"], float) for a in sorted(answers, key=lambda a: a["part"]) if a["part"] >= 3]
        row |= {"answers": [a for a in answers if 0 <= a["part"] < 3], "met": np.concatenate(met), "round": m.DEPTH + 1}
        p, lengths = m._walked(row, v)
        again += np.add.reduceat(np.log10(p), np.cumsum(lengths) - lengths).tolist()
    assert [r["score"] for r in scored] == again


def test_words_of_one_hash_are_counted_apart(monkeypatch):
    monkeypatch.setattr(m, "_hashes", lambda words: np.zeros(len(words), np.uint64))
    docs = some_docs() + [{"doc_id": None, "text": None}, {"doc_id": 999, "text": " \n unmet W2\x0bw2 é\x1cw2 \t"}]
    rows, v, *_ = rounds_here(docs, [b"w1"])
    check_base(docs, [r | {"train_tokens": v.tokens, "score": -1.0} for r in rows])  # runs of one hash are one run


def test_words_as_python_splits_them():
    texts = [b"", b" ", b"a", b" A\tb\x0b\x0cC\r\nd ", "É é\x1c x\xa0y".encode(), b"\xff\xfe \x85z"]
    got, sizes = m._words(pa.array(texts, pa.binary()))
    want = [t.lower().split() for t in texts]
    assert got.cast(pa.binary()).to_pylist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert m._unpack_words(m._pack_words(got)).cast(pa.binary()).to_pylist() == sum(want, [])
