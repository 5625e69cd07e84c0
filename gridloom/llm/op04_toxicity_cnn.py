"""Toxicity by a convolutional text classifier.

Words (lower case, without surrounding punctuation) are hashed into BUCKETS buckets; those met in at
least MIN_DOCS training documents have a row of the embedding, all others share the blank row. The
embedding has at most ROWS rows: beyond that the more frequent half of them are buckets' own, and all
other buckets share the rest. Filters of widths 1, 2 and 3 slide over a text, each filter keeps its
largest response (max pooling), and a logistic layer over the rectified maxima gives the score.

Every labelled document whose crc32(doc_id as text) mod 5 is not 0 takes part: a fifth of them, by a
hash of the doc_id, calibrate, and all others train. Words' documents are counted over all that
train. They are dealt into shards by their hash, of about SHARD_DOCS documents or SHARD_WORDS words.
In each of ROUNDS rounds every shard starts from the common model and passes over all its documents;
the new common model is the mean of the shards' models, for a word's row weighted by how often a
shard moved it. Labels, language, source and doc_id are never inputs of a score. A threshold for each
language, and one for all others, has the fewest errors on all documents that calibrate; it decides
``flagged``, while ``predicted`` is score >= 0.5. Thresholds lie between scores, which are counted in
steps of 1/STEP of their logit.

At scale: labels meet texts in a join that the engine may shuffle, the words of labelled documents are
stored, and a round shuffles those and the shards' changes; the driver holds one model, whatever the
corpus. Scoring is one pass over whole texts with one table look-up a word and filter offset.

Defined results: null or empty text is scored as a text of one blank word; null and repeated
doc_ids are documents like others; labels that are null or contradict each other count as 1 if any
is 1; without labels of both kinds the score is the share of label 1 (0 without any); an empty
table gives an empty result; further columns are ignored. Training is seeded: reruns agree.
"""

from __future__ import annotations

import gc
import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import crc_of_id, drop_stored, small_batches, store, table, text_of, tidy

BUCKETS = 1 << 22
MIN_DOCS = 5
ROWS = 1 << 17
SHARD_DOCS = 6_000
SHARD_WORDS = 4_000_000
ROUNDS = 4
LEAST = 300  # steps of a shard in a round; small shards pass over their documents more than once
BATCH = 48
STEP = 1_000
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
DROP = 0.3
_STRIP = string.punctuation + "«»“”‘’¿¡…–—"
_CACHE = 120_000
_PIECE = 1 << 16
_SPAN = 1 << 13
_known: dict[str, int] = {}


def _forget() -> None:
    _known.clear()


def word_ids(text: str) -> np.ndarray:
    """Bucket of each word; BUCKETS is the blank word, the only one of an empty text."""
    if len(_known) > _CACHE:
        _known.clear()
    words = text.split()
    try:
        out = [_known[w] for w in words]
    except KeyError:
        for w in set(words):
            if w not in _known:
                bare = w.lower().strip(_STRIP)
                _known[w] = zlib.crc32(bare.encode()) % BUCKETS if bare else BUCKETS
        out = [_known[w] for w in words]
    return np.array(out or [BUCKETS], np.int32)


def _lay(docs: list[np.ndarray], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows in a line, each document followed by blanks; where documents start and end."""
    gap = np.full(max(WIDTHS) - 1, blank, np.int32)
    ids = np.concatenate([x for d in docs for x in (d, gap)])
    ends = np.cumsum([len(d) + len(gap) for d in docs]) - len(gap)
    return ids, np.stack([ends - [len(d) for d in docs], ends], axis=1)


@dataclass
class Classifier:
    buckets: np.ndarray  # that have a row other than the blank
    row_of: np.ndarray  # their rows
    embed: np.ndarray  # row 0 is the blank, all zero
    kernels: list[np.ndarray]  # one (width, DIM, FILTERS) for each width
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict = field(default_factory=dict)
    _tables: list | None = None
    _look: np.ndarray | None = None

    def tables(self) -> list[list[np.ndarray]]:
        if self._tables is None:
            self._tables = [[(self.embed @ k[j]).astype(np.float32) for j in range(len(k))] for k in self.kernels]
        return self._tables

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Embedding rows of buckets."""
        if self._look is None:
            self._look = np.zeros(BUCKETS + 1, np.int32)
            self._look[self.buckets] = self.row_of
        return self._look[words]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Scores of documents given as buckets."""
        if not docs:
            return np.zeros(0)
        words, at = _lay(docs, BUCKETS)
        ids = self.rows(words)
        pooled = []
        for tables in self.tables():
            n = len(ids) - len(tables) + 1
            z = tables[0][ids[:n]]
            for j, t in enumerate(tables[1:], 1):
                z += t[ids[j : n + j]]
            pooled.append(np.array([z[a:b].max(axis=0) for a, b in at]))
        h = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0).astype(float)
        # row by row, so that a score does not depend on what else is in the batch
        return 1 / (1 + np.exp(-np.clip((h * self.out).sum(axis=1) + self.shift, -30, 30)))


def _start(buckets: np.ndarray, share: float, seed: int = 11) -> Classifier:
    """Before training. ``buckets`` come by falling number of documents."""
    rng = np.random.default_rng(seed)
    at = np.arange(len(buckets))
    row_of = 1 + (at if len(at) <= ROWS else np.where(at < ROWS // 2, at, ROWS // 2 + at % (ROWS - ROWS // 2)))
    c = Classifier(
        buckets,
        row_of.astype(np.int32),
        np.concatenate([np.zeros((1, DIM)), rng.normal(0, 0.05, (min(len(buckets), ROWS), DIM))]).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    if share in (0.0, 1.0):
        c.out[:] = 0
        c.shift = 30.0 * (1 if share else -1)
    else:
        c.shift = float(np.log(share / (1 - share)))
    return c


def _turns(of: np.ndarray, n: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """``n`` at a time, all of them before any comes again."""
    left = of[:0]
    while True:
        while len(left) < n:
            left = np.concatenate([left, rng.permutation(of)])
        yield left[:n]
        left = left[n:]


def _peaks(c: Classifier, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's largest response to every filter and the place of it, a piece of text at a time."""
    best = np.full((len(at), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    where = np.zeros(best.shape, np.int64)
    flat = np.concatenate([k[j].T for k in c.kernels for j in range(len(k))])
    # one product a row: equal words respond alike, to the last bit, wherever they stand
    used = np.zeros(len(c.embed), bool)
    used[ids] = True
    column = (np.cumsum(used, dtype=np.int64) - 1)[ids]
    table = flat @ c.embed[used].T
    for s in range(0, len(ids), _PIECE):
        e = min(s + _PIECE, len(ids))
        x = table.take(column[s : e + max(WIDTHS) - 1], axis=1, mode="clip")
        docs = range(np.searchsorted(at[:, 1], s, side="right"), np.searchsorted(at[:, 0], e))
        rows = 0
        for n, k in enumerate(c.kernels):
            width = x.shape[1] - len(k) + 1
            z = x[rows : rows + FILTERS, :width]
            for j in range(1, len(k)):
                z += x[rows + j * FILTERS : rows + (j + 1) * FILTERS, j : width + j]
            rows += len(k) * FILTERS
            cols = slice(n * FILTERS, (n + 1) * FILTERS)
            for d in docs:
                a, b = max(at[d, 0], s) - s, min(at[d, 1], e) - s
                top = z[:, a:b].argmax(axis=1) + a
                value = z[np.arange(FILTERS), top]
                more = value > best[d, cols]
                best[d, cols] = np.where(more, value, best[d, cols])
                where[d, cols] = np.where(more, top + s, where[d, cols])
    return best, where


def _fit(c: Classifier, docs: list[np.ndarray], labels: np.ndarray, share: float, steps: int, first: int, total: int, rng: np.random.Generator, batch: int = BATCH) -> np.ndarray:
    """Steps ``first`` and on of ``total`` on documents given as rows, in place: Adam on the log loss,
    where gradients reach the words under each filter's maximum only. How often each row was moved."""
    # batches hold as many of either label; the log loss is weighted back to the true shares
    turns = [_turns(np.flatnonzero(labels == k), batch // 2, rng) for k in (0, 1) if (labels == k).any()]
    weight = np.array([2 * (1 - share), 2 * share])
    dense = [*c.kernels, c.bias, c.out]
    m1, m2 = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    e1, e2 = np.zeros_like(c.embed), np.zeros_like(c.embed)
    moved = np.zeros(len(c.embed), np.int64)
    s1 = s2 = 0.0
    for step in range(1, steps + 1):
        rate = 0.02 * (1 - (first + step) / (total + 1)) + 0.0005
        pick = np.concatenate([next(t) for t in turns])
        # words are dropped at random, so that no document hangs on one of them
        ids, at = _lay([np.where(rng.random(len(docs[i]), np.float32) < DROP, 0, docs[i]) for i in pick], 0)
        y = labels[pick].astype(float)
        pooled, where = _peaks(c, ids, at)
        h0 = pooled + c.bias
        h = np.maximum(h0, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ c.out + c.shift, -30, 30)))
        g = (p - y) * weight[y.astype(int)] / batch
        gh = (np.outer(g, c.out) * (h0 > 0)).astype(np.float32)
        grads, rows, parts = [], [], []
        for n, k in enumerate(c.kernels):
            cols = slice(n * FILTERS, (n + 1) * FILTERS)
            part = gh[:, cols]
            gk = np.zeros_like(k)
            for j in range(len(k)):
                under = ids[where[:, cols] + j]
                gk[j] = np.einsum("df,dfe->ef", part, c.embed[under])
                live = (under != 0) & (part != 0)
                rows.append(under[live])
                parts.append((part[:, :, None] * k[j].T[None])[live])
            grads.append(gk + 1e-4 * k)
        grads += [gh.sum(axis=0), h.T @ g + 1e-4 * c.out]
        rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        change = 3e-4 * c.embed[rows]
        np.add.at(change, inverse, np.concatenate(parts))
        for q, gq, a, b in zip(dense, grads, m1, m2):
            a += 0.1 * (gq - a)
            b += 0.001 * (gq * gq - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        s1 += 0.1 * (g.sum() - s1)
        s2 += 0.001 * (g.sum() ** 2 - s2)
        c.shift -= float(rate * (s1 / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.999**step)) + 1e-8))
        e1[rows] = 0.9 * e1[rows] + 0.1 * change
        e2[rows] = 0.99 * e2[rows] + 0.01 * change * change
        c.embed[rows] -= rate * e1[rows] / (np.sqrt(e2[rows]) + 1e-6)
        moved[rows] += 1
    return moved


def train(docs: list[np.ndarray], labels: np.ndarray, steps: int = ROUNDS * LEAST, batch: int = BATCH, seed: int = 11) -> Classifier:
    """One shard's training by itself, on documents given as buckets."""
    met, times = np.unique(np.concatenate([np.unique(d) for d in docs] or [np.zeros(0, np.int32)]), return_counts=True)
    share = float(labels.mean()) if len(labels) else 0.0
    c = _start(met[(times >= MIN_DOCS) & (met < BUCKETS)], share, seed)
    if share not in (0.0, 1.0):
        _fit(c, [c.rows(d) for d in docs], labels, share, steps, 0, steps, np.random.default_rng(seed), batch)
    return c


def _flat(c: Classifier) -> np.ndarray:
    return np.concatenate([*(p.ravel() for p in [*c.kernels, c.bias, c.out]), [c.shift]]).astype(float)


def _shard(model, share: float, round_: int):
    """A shard's pass over all its documents, and its changes: -1 is the part of all dense numbers,
    the others are spans of the embedding."""

    def run(group: pa.Table) -> pa.Table:
        m = model.value
        c = Classifier(m.buckets, m.row_of, m.embed.copy(), [k.copy() for k in m.kernels], m.bias.copy(), m.out.copy(), m.shift)
        rows = group.select(["at", "doc_id", "lang", "toxic"]).to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (rows[i]["at"], rows[i]["doc_id"], rows[i]["lang"] or "", rows[i]["toxic"]))
        words = group["words"]
        docs = [c.rows(np.frombuffer(words[i].as_py(), np.int32)) for i in order]
        y = np.array([int(rows[i]["toxic"] > 0) for i in order])
        once = math.ceil(max(y.sum(), len(y) - y.sum()) / (BATCH // 2))
        steps = once * max(1, round(LEAST / once))
        shard = group["shard"][0].as_py()
        moved = _fit(c, docs, y, share, steps, round_ * steps, ROUNDS * steps, np.random.default_rng([11, round_, shard]))
        live = np.flatnonzero(moved)
        change = c.embed[live] - m.embed[live]
        out = [(-1, b"", np.array([len(docs)]), _flat(c) - _flat(m))]
        for k in np.unique(live // _SPAN).tolist():
            a, b = np.searchsorted(live, [k * _SPAN, (k + 1) * _SPAN])
            out.append((k, (live[a:b] - k * _SPAN).astype(np.int32).tobytes(), moved[live[a:b]], change[a:b]))
        return _parts([(k, shard, r, n.astype(np.int64).tobytes(), d.tobytes()) for k, r, n, d in out])

    return run


_PARTS = "part int, shard int, rows binary, weight binary, change binary"


def _parts(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(_PARTS.split(", "), kinds))})


def _mean(group: pa.Table) -> pa.Table:
    """A part's weighted mean over the shards."""
    said = sorted(group.to_pylist(), key=lambda r: r["shard"])
    part = said[0]["part"]
    total: np.ndarray | float = 0.0 if part < 0 else np.zeros((_SPAN, DIM))
    weight = np.zeros(1 if part < 0 else _SPAN, np.int64)
    for r in said:
        n = np.frombuffer(r["weight"], np.int64)
        if part < 0:
            total, weight = total + n * np.frombuffer(r["change"]), weight + n
        else:
            at = np.frombuffer(r["rows"], np.int32)
            total[at] += n[:, None] * np.frombuffer(r["change"], np.float32).reshape(-1, DIM)
            weight[at] += n
    if part < 0:
        return _parts([(part, 0, b"", weight.tobytes(), (total / weight).tobytes())])
    at = np.flatnonzero(weight)
    return _parts([(part, 0, at.astype(np.int32).tobytes(), weight[at].tobytes(), (total[at] / weight[at, None]).astype(np.float32).tobytes())])


def _apply(c: Classifier, parts: list) -> None:
    for r in parts:
        if r["part"] >= 0:
            c.embed[r["part"] * _SPAN + np.frombuffer(r["rows"], np.int32)] += np.frombuffer(r["change"], np.float32).reshape(-1, DIM)
            continue
        change, at = np.frombuffer(r["change"]), 0
        for p in [*c.kernels, c.bias, c.out]:
            p += change[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        c.shift += float(change[at])


def _cutoff(score: np.ndarray, y: np.ndarray) -> float:
    """Middle of the best gap between scores, by errors weighted alike; 0.5 without both labels."""
    of, at = np.unique(score, return_inverse=True)
    return _cut(of, of, np.bincount(at, 1 - y, len(of)), np.bincount(at, y, len(of)))


def _cut(low: np.ndarray, high: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """:func:`_cutoff` of documents counted by label in ascending steps, whose scores go from ``low``
    to ``high``."""
    if not (clean.sum() and toxic.sum()):
        return 0.5
    # above a cut: missed label 1 below it, false label 1 above it
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    below, above = np.concatenate([[0.0], high]), np.concatenate([low, [1.0]])
    k = best[(above - below)[best].argmax()]
    return float((below[k] + above[k]) / 2)


def _cut_of(group: pa.Table) -> pa.Table:
    group = group.sort_by("step")
    at = _cut(*(group[c].to_numpy() for c in ("low", "high", "clean", "toxic")))
    return pa.table({"lang": group["lang"][:1], "cut": pa.array([at])})


def _as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, doc_id, lang, toxic, text) with the buckets of the text's words in its place."""
    for batch in batches:
        words = [word_ids(t).tobytes() for t in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(words, pa.binary())], names=["at", "doc_id", "lang", "toxic", "words"])


def _count_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each bucket."""
    seen = np.zeros(BUCKETS + 1, np.int32)
    for batch in batches:
        for words in batch.column(0).to_pylist():
            seen[np.unique(np.frombuffer(words, np.int32))] += 1
    met = np.flatnonzero(seen[:BUCKETS])
    for k in range(0, len(met), 100_000):
        some = met[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some].astype(np.int64))], names=["bucket", "docs"])


def _score_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.value.score([np.frombuffer(w, np.int32)])[0] for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score, pa.float64())], names=["lang", "toxic", "score"])

    return run


def _only_tables(c: Classifier) -> Classifier:
    """What scoring needs."""
    return Classifier(c.buckets, c.row_of, np.zeros((1, 1)), c.kernels, c.bias, c.out, c.shift, c.thresholds, c.tables())


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit on every labelled document that is not held out. The driver holds one model, no texts or
    words."""
    spark = docs.sparkSession
    small_batches(spark)
    in_training = lambda c: F.pmod(crc_of_id(c), F.lit(5)) != 0
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.filter(in_training("id"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"), lang.cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & in_training("doc_id"))
    sample = rows.join(marked.hint("shuffle_hash"), F.col("doc_id") == F.col("id")).select(F.xxhash64("doc_id", "text").alias("at"), "doc_id", "lang", "toxic", "text")
    sample = store(sample.mapInArrow(tidy(_as_words, _forget), "at bigint, doc_id bigint, lang string, toxic int, words binary"), "marked")
    calibrates = F.pmod(F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string")).cast("binary")), F.lit(5)) == 0
    learnt, check = sample.filter(~calibrates), sample.filter(calibrates)
    n, toxic, words = learnt.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("bigint")), F.sum(F.length("words").cast("bigint") / 4)).first()
    share = toxic / n if n else 0.0
    counts = store(learnt.select("words").mapInArrow(tidy(_count_docs), "bucket int, docs bigint").groupBy("bucket").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= MIN_DOCS), "buckets")
    met = counts.toArrow()  # at most BUCKETS
    drop_stored(counts)
    buckets, times = met["bucket"].to_numpy(), met["docs"].to_numpy()
    c = _start(buckets[np.lexsort([buckets, -times])], share)
    shards = max(1, math.ceil(n / SHARD_DOCS), math.ceil((words or 0) / SHARD_WORDS))
    dealt = learnt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "at"), F.lit(shards)).cast("int"))
    for k in range(ROUNDS if 0 < share < 1 else 0):
        model = spark.sparkContext.broadcast(Classifier(c.buckets, c.row_of, c.embed, c.kernels, c.bias, c.out, c.shift))  # at most ROWS rows
        changes = store(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard(model, share, k), _PARTS).groupBy("part").applyInArrow(_mean, _PARTS), "changes")
        _apply(c, changes.collect())
        drop_stored(changes)
        model.destroy()
    model = spark.sparkContext.broadcast(_only_tables(c))
    logit = F.log(F.col("score") / (1 - F.col("score")))
    steps = check.select("lang", "toxic", "words").mapInArrow(tidy(_score_words(model)), "lang string, toxic int, score double")
    steps = steps.groupBy("lang", F.floor(logit * STEP).alias("step"))
    counted = [F.min("score").alias("low"), F.max("score").alias("high"), F.sum((F.col("toxic") <= 0).cast("bigint")).alias("clean"), F.sum((F.col("toxic") > 0).cast("bigint")).alias("toxic")]
    steps = store(steps.agg(*counted), "scores")
    merged = [F.min("low").alias("low"), F.max("high").alias("high"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")]
    every = steps.groupBy("step").agg(*merged).orderBy("step").toArrow()  # at most 60 * STEP
    c.thresholds = {None: _cut(*(every[x].to_numpy() for x in ("low", "high", "clean", "toxic")))}
    enough = steps.filter("lang is not null").groupBy("lang").agg(F.sum("toxic").alias("n")).filter("n >= 10").select("lang")
    cuts = steps.join(enough, "lang").groupBy("lang").applyInArrow(_cut_of, "lang string, cut double")
    c.thresholds |= {r["lang"]: r["cut"] for r in cuts.collect()}
    drop_stored(steps, sample)
    model.destroy()
    # the driver has little memory to spare
    c._look = None
    gc.collect()
    return c


def classify(docs: DataFrame, c: Classifier, keep: list[str], lang: str | None = "lang") -> DataFrame:
    """``keep`` columns, gl_score and gl_threshold (of the document's language)."""
    small_batches(docs.sparkSession)
    have = lang is not None and lang in docs.columns
    rows = docs.select(*keep, text_of("text").alias("gl_text"), (F.col(lang).cast("string") if have else F.lit(None).cast("string")).alias("gl_lang"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]), "gl_score double, gl_threshold double"])
    model = docs.sparkSession.sparkContext.broadcast(_only_tables(c))  # at most ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            scores, some, held = [], [], 0
            for t in texts:
                some.append(word_ids(t))
                held += len(some[-1])
                if held > 50_000:
                    scores.append(m.score(some))
                    some, held = [], 0
            scores.append(m.score(some))
            limits = [m.thresholds.get(x, m.thresholds[None]) for x in batch.column(len(keep) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(scores)), pa.array(limits, pa.float64())], names=[*keep, "gl_score", "gl_threshold"])

    return rows.mapInArrow(tidy(run, _forget), schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold of their language; columns as they came."""
    c = learn(docs, table(spark, sf_dir, "labels"))
    return classify(docs, c, docs.columns).filter("gl_score < gl_threshold").select(*docs.columns)


def op04_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classify(docs, learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.pmod(crc_of_id("doc_id"), F.lit(5)) == 0).alias("held_out"),
        F.col("gl_score").alias("score"),
        (F.col("gl_score") >= 0.5).cast("int").alias("predicted"),
        F.col("gl_threshold").alias("threshold"),
        (F.col("gl_score") >= F.col("gl_threshold")).alias("flagged"),
    )


QUERIES = {"op4_toxicity_cnn": op04_query}
ORACLE: dict[str, str] = {}
