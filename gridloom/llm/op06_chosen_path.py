"""N-gram Jaccard join by chosen paths.

Texts are sets of word n-grams (hashed to 64 bits); texts of equal sets form one representative
with a number of copies. Of each representative T min-hashes stand for its set. In every run the
representatives start in one node, and recursively each goes on into the children of its node named
by those of its min-hashes that a hash of (run, path, min-hash) selects, GROWTH / threshold of them
on average. Two sets share a path with probability q, the root of q = 1 - exp(-GROWTH * q), at
least, if they reach the threshold, so runs are repeated until 1 - (1 - q)**runs is the target
recall. What a node can still tell
are links between different components of the links found so far. Where at most SMALL members stand
outside the node's largest component, these are compared with all its members by brute force, in
tasks of about SALT members. In other nodes every member is first compared with a pivot, once for
each pair of member and pivot however many nodes have it; members settled there (whatever is similar
to them is similar enough to the pivot to be linked to it as well) leave. Then the same node is
looked at again, and only if it still has more than SMALL strangers do its members go on into its
children. So a group of near copies costs a few links a member: it becomes one component in the
first node that it fills, and never descends.

Pairs whose min-hashes agree enough become links of candidate components. Components of up to BLOCK
texts are compared exactly, all pairs of whole n-gram sets, in one task. In larger ones each text is
shipped once and turned into its difference from a centre, the n-grams that most of a piece of the
component have: with X, Y the differences, |A & B| = |P| - |P - A| - |P - B| + |X & Y|, exactly.
Texts at a Jaccard distance of at most half of what the threshold allows from the centre (the core)
are all linked to one another by the triangle inequality and need no comparison, and texts too far
from it are linked to none of the core; all other pairs are compared by their differences in blocks
of about WIDE members or WIDE_BYTES. Only counts of links and spanning links leave a task, never
pairs, and classes are the connected components of the exact links.

At scale: n-grams and texts are shuffled for members of candidate components only. Groups are
pre-aggregated; the joins that meet a hot node or component have a stored other side, so adaptive
execution can split them. Nothing is collected. What stays quadratic are the links of a component's
n members outside its core: their differences go to n / WIDE tasks each.

Defined results: a text of fewer than n words has one n-gram, all its words; a text without words
(null included) has no n-gram and links to nothing, not even to its like; a document's links are
the other documents at or above the threshold, copies included; class_id is the smallest doc_id of
the class (null if there is none); null and repeated doc_ids are documents like others; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import drop_stored, few, fresh, once_each, partitions, small_batches, store, table, text_of, tidy
from gridloom.operators.graph import components

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
T = 64
GROWTH = 2.0
SMALL = 1024
DEPTH = 8
SALT = 2048
BLOCK = 128
#: Of components above BLOCK: texts in the piece that gives the centre and in a piece of one task,
#: members and bytes of differences in a block.
PIECE = 512
WIDE = 1024
WIDE_BYTES = 8 << 20
#: Shares of equal min-hashes (standard error 0.05 at the threshold) that make a pair a candidate,
#: link a member to a pivot, and settle it there.
NEAR, LINK, SETTLED = 0.55, 0.45, 0.85
#: Ids of members up to this number are broadcast (8 MB); beyond it the texts are joined by shuffle.
MAX_BROADCAST = 500_000

_P = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, T, dtype=np.uint64)
_words: dict[bytes, int] = {}


def _forget() -> None:
    _words.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_ids(text: bytes) -> np.ndarray:
    words = text.split()
    if len(_words) > 200_000:
        _words.clear()
    try:
        return np.array([_words[w] for w in words], np.uint64)
    except KeyError:
        for w in set(words):
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w)
        return np.array([_words[w] for w in words], np.uint64)


def shingles(text: bytes, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    ids = _word_ids(text)
    k = min(n, len(ids))
    if not k:
        return np.zeros(0, np.uint64)
    h = np.full(len(ids) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _P + ids[j : len(ids) - k + 1 + j]
    return np.unique(_mix(h))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """T min-hashes of each non-empty set."""
    out = np.empty((len(sets), T), np.uint32)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) < 100_000):
            n += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]], dtype=np.int64)]).astype(np.int64)
        for i in range(T):
            out[at:to, i] = np.minimum.reduceat(((flat * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32), starts)
        at = to
    return out


def _describe(n: int):
    """(rid, doc_id, th, text) to (rid, doc_id, th, size, set, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(3).to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            if full:
                for k, row in zip(full, signatures([sets[k] for k in full])):
                    sig[k] = row.tobytes()
            names = [hashlib.sha256(s.tobytes()).digest()[:16] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(sig, pa.binary())], names=["rid", "doc_id", "th", "size", "name", "sig"]
            )

    return run


def _children(node: np.ndarray, sig: np.ndarray, threshold: float, growth: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and names of the child nodes that each row goes on to."""
    token = _mix(sig.astype(np.uint64) * _P + np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    names = _mix(token ^ node[:, None])
    rows, cols = np.nonzero(_mix(names + _P) < np.uint64(min(1.0, growth / (threshold * T)) * 2**63) * np.uint64(2))
    return rows, names[rows, cols]


def _start(runs: int, threshold: float, growth: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, T)
            for r in range(runs):
                node = np.full(len(ids), _mix(np.array([r + 1], np.uint64))[0])
                rows, names = _children(node, sig, threshold, growth)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(ids[rows])], names=["node", "id"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sig, pivot, pivot's sig) to (id, pivot, share of equal min-hashes)."""
    for batch in batches:
        sig, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, T) for k in (1, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((sig == other).mean(axis=1))], names=["id", "pivot", "alike"])


def _descend(threshold: float, growth: float):
    """(node, id, sig) to the children (node, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, T)
            rows, names = _children(node, sig, threshold, growth)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(ids[rows])], names=["node", "id"])

    return run


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each member's connected group."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal first ``keys`` columns of a sorted partition."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        key = pdf.iloc[:, :keys]
        cut = np.flatnonzero((key.to_numpy()[1:] != key.to_numpy()[:-1]).any(axis=1)) + 1
        edges = [0, *cut.tolist(), len(pdf)]
        for a, b in zip(edges, edges[1:]):
            part = pdf.iloc[a:b]
            if held and tuple(held[-1].iloc[0, :keys]) != tuple(part.iloc[0, :keys]):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, salt, main, id, sig), sorted by node and salt: spanning links among the candidates of
    each group, between members outside the largest component and all members."""
    found: list[np.ndarray] = []
    held: list = []

    def close() -> None:
        if len(held) < 2:
            return
        ids = np.array([r[1] for r in held], np.int64)
        sig = np.frombuffer(b"".join([r[2] for r in held]), np.uint32).reshape(-1, T)
        if len(ids) == 2:
            if ids[0] != ids[1] and (sig[0] == sig[1]).mean() >= NEAR:
                found.append(np.array([[max(ids), min(ids)]]))
            return
        order = np.argsort(ids, kind="stable")
        ids, sig = ids[order], sig[order]
        strange = np.flatnonzero(~np.array([r[0] for r in held])[order])
        pairs = []
        for i in strange:
            near = np.flatnonzero((sig == sig[i]).sum(axis=1) >= NEAR * T)
            pairs.append(np.stack([np.full(len(near), i), near], axis=1))
        root = _roots(len(ids), np.concatenate([*pairs, np.zeros((0, 2), np.int64)]))
        own = ids[root] != ids
        found.append(np.stack([ids[own], ids[root[own]]], axis=1))

    def out() -> pa.RecordBatch:
        flat = np.concatenate([*found, np.zeros((0, 2), np.int64)])
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["id", "to"])

    at = None
    for batch in batches:
        for node, salt, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, salt) != at:
                close()
                at, held = (node, salt), []
            held.append(row)
        yield out()
    close()
    yield out()


def _components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each id's connected component, for ids that have a link."""
    return components(links.select(F.col("id").alias("src"), F.col("to").alias("dst"))).select(F.col("v").alias("id"), F.col("component").alias("root"))


def _overlap(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections, within a, or between a and b."""
    if len(a) <= 4 and b is None:
        out = np.zeros((len(a), len(a)))
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                out[i, j] = out[j, i] = len(np.intersect1d(a[i], a[j], assume_unique=True))
        return out
    sets = [*a, *(b or [])]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    u, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    # an n-gram of one set alone is in no intersection
    shared = count[inverse] > 1
    column = np.cumsum(count > 1)[inverse[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(a), len(b) if b is not None else len(a)))
    n, step = int(column[-1]) + 1 if len(column) else 0, 2048
    for at in range(0, n, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(a)] @ (m[len(a) :] if b is not None else m).T
    return out


_EXACT = pa.schema([("id", pa.int64()), ("to", pa.int64()), ("docs", pa.int64()), ("texts", pa.int64())])
_EXACT_SQL = "id bigint, to bigint, docs bigint, texts bigint"


def _linked(ids: list[np.ndarray], copies: list[np.ndarray], hit: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of links and spanning links from the matrix of links within a block, or between two."""
    if len(ids) == 1:
        found, every, pairs = [(hit @ copies[0], hit.sum(axis=1))], ids[0], np.argwhere(np.triu(hit))
    else:
        found = [(hit @ copies[1], hit.sum(axis=1)), (hit.T @ copies[0], hit.sum(axis=0))]
        every, pairs = np.concatenate(ids), np.argwhere(hit) + [0, len(ids[0])]
    root = every[_roots(len(every), pairs)]
    docs, texts = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
    own = texts > 0
    yield pa.RecordBatch.from_arrays([pa.array(every[own]), pa.array(root[own]), pa.array(docs[own]), pa.array(texts[own])], schema=_EXACT)


def _verify(threshold: float, n: int):
    """(comp, id, copies, text), sorted: exact links within each small component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            g = g.drop_duplicates("id")
            sets = [shingles(t, n) for t in g["text"]]
            size = np.array([len(s) for s in sets], float)
            o = _overlap(sets, None)
            hit = o >= threshold * (size[:, None] + size[None] - o) - 1e-9
            np.fill_diagonal(hit, False)
            yield from _linked([g["id"].to_numpy(np.int64)], [g["copies"].to_numpy(np.int64)], hit)

    return run


def _centre(n: int):
    """(comp, id, text), sorted: the n-grams that more than half of a component's texts here have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            texts = g.drop_duplicates("id")["text"]
            grams, count = np.unique(np.concatenate([shingles(t, n) for t in texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([int(g.iloc[0, 0])], pa.int64()), pa.array([grams[2 * count > len(texts)].tobytes()], pa.binary())], names=["comp", "body"])

    return run


def _differences(threshold: float, n: int):
    """(comp, piece, kind, id, copies, body), sorted: the centre's n-grams (kind 0), then texts, each
    to its difference from the centre and its zone: far 0, middle 1, core 2."""
    slack = 1 - threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, last = np.zeros(0, np.uint64), None
        for batch in batches:
            out: list[tuple] = []
            for comp, kind, key, copies, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if kind == 0:
                    centre = np.frombuffer(body, np.uint64)
                elif key != last:
                    own = shingles(body, n)
                    diff = np.setxor1d(own, centre, assume_unique=True)
                    both = (len(own) + len(centre) - len(diff)) // 2
                    far = 1 - both / (len(own) + len(centre) - both)
                    zone = 2 if far <= slack / 2 - 1e-9 else 1 if far <= 1.5 * slack + 1e-9 else 0
                    out.append((comp, key, copies, len(own), len(centre) - both, len(centre), zone, 8 * len(diff), diff.tobytes()))
                last = key
            cols = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.binary())], names=["comp", "id", "copies", "size", "gone", "base", "zone", "bytes", "diff"])

    return run


_DIFFERENCES = "comp bigint, id bigint, copies bigint, size bigint, gone bigint, base bigint, zone bigint, bytes bigint, diff binary"


def _verify_blocks(threshold: float):
    """(comp, bi, bj, side, id, copies, size, gone, base, diff), sorted: exact links within a block,
    or between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            same = g.iloc[0, 1] == g.iloc[0, 2]
            parts = [g] if same else [g[g["side"] == s] for s in (0, 1)]
            if not all(len(p) for p in parts):
                continue
            sets = [[np.frombuffer(d, np.uint64) for d in p["diff"]] for p in parts]
            size, gone = ([p[c].to_numpy(float) for p in parts] for c in ("size", "gone"))
            o = _overlap(sets[0], None if same else sets[1]) + float(g["base"].iloc[0]) - gone[0][:, None] - gone[-1][None]
            hit = o >= threshold * (size[0][:, None] + size[-1][None] - o) - 1e-9
            if same:
                np.fill_diagonal(hit, False)
            yield from _linked([p["id"].to_numpy(np.int64) for p in parts], [p["copies"].to_numpy(np.int64) for p in parts], hit)

    return run


def _large_links(spark: SparkSession, whole: DataFrame, threshold: float, ngram: int, wide: int) -> DataFrame:
    """Exact links of the components above BLOCK: (comp, n, id, copies, text)."""
    n = partitions(spark)
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    whole = store(whole.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")), "large")
    first = whole.filter("piece = 0").select("comp", "pieces", "id", "text")
    centres = first.select("comp", "id", "text").repartition(n, "comp").sortWithinPartitions("comp", "id").mapInArrow(tidy(_centre(ngram), _forget), "comp bigint, body binary")
    counts = whole.groupBy("comp").agg(F.max("pieces").alias("pieces"))
    # a piece without a centre's row (its piece 0 is empty) has an empty centre
    heads = store(counts.join(centres, "comp", "left"), "centres")
    null = F.lit(None).cast("bigint")
    heads = heads.select("comp", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("kind"), null.alias("id"), null.alias("copies"), F.coalesce("body", F.lit(b"")).alias("body"))
    rows = heads.unionByName(whole.select("comp", "piece", F.lit(1).alias("kind"), "id", "copies", F.col("text").alias("body")))
    rows = rows.repartition(n, "comp", "piece").sortWithinPartitions("comp", "piece", "kind", "id")
    diffs = store(rows.mapInArrow(tidy(_differences(threshold, ngram), _forget), _DIFFERENCES), "differences")
    zone = F.col("zone")
    blocks = [F.greatest(F.ceil(F.count_if(zone == z) / wide), F.ceil(F.sum(F.when(zone == z, F.col("bytes")).otherwise(0)) / WIDE_BYTES)).cast("int").alias(f"b{z}") for z in (0, 1, 2)]
    core = F.when(zone == 2, F.col("copies"))
    zones = diffs.groupBy("comp").agg(*blocks, F.sum(core).alias("core_docs"), F.count(core).alias("core_texts"), F.min(F.when(zone == 2, F.col("id"))).alias("core_low"))
    dealt = diffs.join(store(zones, "zones"), "comp")
    inner = dealt.filter((zone == 2) & (F.col("core_texts") > 1))
    inner = inner.select("id", F.col("core_low").alias("to"), (F.col("core_docs") - F.col("copies")).alias("docs"), (F.col("core_texts") - 1).alias("texts"))
    far, near = F.col("b0"), F.col("b0") + F.col("b1")
    mine = F.when(zone == 0, F.pmod(F.xxhash64("id"), far)).when(zone == 1, far + F.pmod(F.xxhash64("id"), F.col("b1"))).otherwise(near + F.pmod(F.xxhash64("id"), F.col("b2"))).cast("int")
    low = F.when(zone == 2, far).otherwise(F.lit(0))
    high = F.when(zone == 1, near + F.col("b2")).otherwise(near)
    others = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(others, lambda o: F.struct(F.least("mine", o).alias("bi"), F.greatest("mine", o).alias("bj"), (F.col("mine") > o).cast("int").alias("side")))
    dealt = dealt.withColumn("mine", mine).withColumn("p", F.explode(pairs)).select("comp", "p.bi", "p.bj", "p.side", "id", "copies", "size", "gone", "base", "diff")
    dealt = dealt.repartition(n, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "side", "id")
    out = store(inner.unionByName(dealt.mapInArrow(tidy(_verify_blocks(threshold)), _EXACT_SQL)), "exact")
    drop_stored(whole, diffs)
    return out


def runs_for(recall: float, growth: float = GROWTH) -> int:
    q = 0.5
    for _ in range(200):
        q = 1 - math.exp(-growth * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def candidate_links(reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, growth: float = GROWTH, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(id, to) spanning links of candidate components among representatives (id, sig)."""
    spark = reps.sparkSession
    n = partitions(spark)
    sigs = reps.select("id", "sig")
    rows = store(sigs.mapInArrow(_start(runs_for(recall, growth), threshold, growth), "node bigint, id bigint"), "paths")
    links = None
    for step in range(2 * depth + 1):
        # even steps see new nodes, odd ones the same nodes after the comparison with their pivots
        some = rows.count()
        if links is None:
            rooted = rows.withColumn("root", F.col("id"))
            held = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("pivot"))
            sizes = held.filter("n > 1").select("node", "n", "pivot", F.col("pivot").alias("main"), F.lit(1).cast("bigint").alias("most"))
        else:
            roots = store(_components(links), "roots")
            links = roots.filter("id <> root").select("id", F.col("root").alias("to"))
            rooted = store(rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted", some)
            held = rooted.groupBy("node", "root").agg(F.count("*").alias("c"), F.min("id").alias("low"))
            held = held.groupBy("node").agg(F.sum("c").alias("n"), F.min("low").alias("pivot"), F.max(F.struct("c", "root")).alias("m"))
            sizes = held.select("node", "n", "pivot", F.col("m.root").alias("main"), F.col("m.c").alias("most")).filter("most < n")
        sizes = store(sizes, "nodes", some)
        met = store(rooted.join(sizes, "node"), "met", some)
        drop_stored(rows, rooted, sizes)
        if step == 2 * depth:
            # what no level has split: all of a node's rest is linked, and compared exactly later
            return links.unionByName(met.filter("id <> pivot").select("id", F.col("pivot").alias("to")))
        strangers = F.col("n") - F.col("most")
        salts = F.ceil(F.col("n") / SALT).cast("int")
        main = F.col("root") == F.col("main")
        mine = F.pmod(F.xxhash64("id"), salts).cast("int")
        dealt = met.filter(strangers <= small).select("node", "id", main.alias("main"), F.explode(F.when(main, F.array(mine)).otherwise(F.sequence(F.lit(0), salts - 1))).alias("salt"))
        dealt = dealt.join(sigs, "id").select("node", "salt", "main", "id", "sig")
        near = dealt.repartition(n, "node", "salt").sortWithinPartitions("node", "salt")
        near = store(few(near, 4 * met.count(), 20_000).mapInArrow(tidy(_brute), "id bigint, to bigint").distinct(), "near", some)
        links = near if links is None else links.unionByName(near)
        many = met.filter(strangers > small)
        count = many.count()
        if not count:
            drop_stored(met)
            return links
        if step % 2 == 0:
            # each pair of member and pivot once, whatever the number of nodes that have it
            pairs = many.filter("id <> pivot").select("id", "pivot").distinct()
            pairs = pairs.join(sigs, "id").join(sigs.select(F.col("id").alias("pivot"), F.col("sig").alias("other")), "pivot").select("id", "sig", "pivot", "other")
            alike = store(few(pairs, count, 20_000).mapInArrow(_alike, "id bigint, pivot bigint, alike double"), "pivots")
            links = links.unionByName(alike.filter(F.col("alike") >= LINK).select("id", F.col("pivot").alias("to")))
            rows = many.join(alike.filter(F.col("alike") < SETTLED).select("id", "pivot"), ["id", "pivot"]).select("node", "id")
        else:
            rows = few(many.join(sigs, "id").select("node", "id", "sig"), count, 20_000).mapInArrow(_descend(threshold, growth), "node bigint, id bigint")
        rows = store(rows, "paths", count)
        drop_stored(met)


def similar(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, recall: float = RECALL, block: int = BLOCK, wide: int = WIDE, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """One row a document: doc_id, class_id, n_links, n_texts (links to other n-gram sets),
    class_size, th (hash of the text), first (the one row of its class that has class_id)."""
    spark = docs.sparkSession
    n = partitions(spark)
    small_batches(spark)
    text = text_of("text")
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    rows = named.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "th", "text")
    seen = store(rows.mapInArrow(tidy(_describe(ngram), _forget), "rid bigint, doc_id bigint, th bigint, size bigint, name binary, sig binary"), "sets")
    first = F.min(F.struct(F.col("rid").alias("id"), F.col("doc_id"), F.col("th"), F.col("sig")))
    reps = seen.filter("size > 0").groupBy("name").agg(first.alias("f"), F.count("*").alias("copies"), F.min("doc_id").alias("low"))
    reps = store(reps.select("name", "f.*", "copies", "low"), "reps")
    comps = store(_components(candidate_links(reps, threshold, recall, small=small, depth=depth)), "components")
    sizes = store(comps.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    member = comps.join(sizes, "root").join(reps.select("id", F.col("doc_id").alias("at_id"), F.col("th").alias("at_th"), "copies"), "id")
    member = store(member.select("id", F.col("root").alias("comp"), "n", "at_id", "at_th", "copies"), "members")
    # exact comparison of their texts; up to MAX_BROADCAST members the texts of others stay where they are
    some, large = member.agg(F.count("*"), F.count_if(F.col("n") > block)).first()

    def whole(of: DataFrame) -> DataFrame:
        side = F.broadcast(of) if some <= MAX_BROADCAST else of
        return named.join(side, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("th") == F.col("at_th"))).select("comp", "n", "id", "copies", "text")

    dealt = whole(member.filter(F.col("n") <= block)).select("comp", "id", "copies", "text").repartition(n, "comp").sortWithinPartitions("comp", "id")
    exact = store(dealt.mapInArrow(tidy(_verify(threshold, ngram), _forget), _EXACT_SQL), "exact")
    if large:
        exact = exact.unionByName(_large_links(spark, whole(member.filter(F.col("n") > block)), threshold, ngram, wide))
    links = exact.groupBy("id").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    classes = _components(exact.select("id", "to"))
    known = reps.select("name", "id", "copies", "low", "doc_id").join(links, "id", "left").join(classes, "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = store(known, "known")
    of = store(known.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size")), "classes")
    known = known.join(of, "root").select("name", "root", "class_id", "class_size", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    known = store(known, "known")
    out = seen.select("rid", "doc_id", "th", "size", "name").join(known, "name", "left")
    out = store(out, "all")
    lead = out.filter("root is not null").groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))).alias("l"))
    out = out.join(store(lead.select("r", F.col("l.rid").alias("lead")), "leads"), F.col("root") == F.col("r"), "left")
    alone = F.col("root").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_texts"),
        F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"),
        "th",
        (alone | (F.col("lead") == F.col("rid"))).alias("first"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of similar texts; columns as they came. Texts without words
    are in no class and all stay."""
    found = similar(docs).filter("class_size > 1").select(F.struct("doc_id", "th").alias("key"), "first")
    return once_each(docs, F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of("text")).alias("th")), found)


def op06_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents")).drop("th", "first")


QUERIES = {"op6_chosen_path": op06_query}
ORACLE: dict[str, str] = {}
