"""Language-model scoring by a probabilistic suffix tree over words.

Words are lower-cased A-Z and split at white space; an end follows each document. The root gives each
word its smoothed share of the training tokens. A context is a run of one to DEPTH words that occurs
at least MIN times in the training documents, anywhere in the corpus: an absolute number, so the tree
grows with the corpus. Every word that followed a context is an entry of it, whatever its count.
Distributions are smoothed by the suffix's: (n(context, word) + MU * P(word | suffix)) /
(n(context) + MU). The divergence test keeps a context if it predicts its own occurrences, each left
out of its counts, better than its suffix does: the sum over them of the logarithm of the two
probabilities' ratio is above MARGIN. Scoring takes the longest kept context at each word.

At scale nothing of the tree is broadcast or collected. Documents are encoded in chunks of about CHUNK
tokens. A chunk asks for totals: its distinct runs, each once with its count in the chunk, go as sorted
blobs to the part their hash falls in; the part adds them over all chunks and answers each blob in its
order. So no run is a hot key, and a part holds about PART tokens' runs at any size. Round k asks for
runs of k + 2 words after contexts that round k - 1 found MIN times, and for the test of contexts of
k words. Words outside the dictionary are asked about as they are, in round 0. What a chunk was told
goes along to its later rounds, which sort nothing of earlier ones but what was asked last. Chunks lie
bucketed, so that only questions and answers are shuffled. Broadcast are the words with at least
DICTIONARY of all tokens, at most 1/DICTIONARY of them.

Runs are told apart by a hash with 2**SPARE times as many values as 4 x the tokens, so that a run
meets another one's hash with a chance of about 2**-SPARE; in runs, words outside the dictionary have
44 bits. That touches ``score`` only: counts of words are of words themselves.

Defined results: null text is empty text, which is one end; null and repeated doc_ids are documents
like others (a null id counts as empty text in the hash); without training documents all counts
are 0 and both scores are 0; an empty table gives an empty result; further columns are ignored. A
document longer than CHUNK is a chunk by itself.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import crc_of_id, drop_stored, new_path, partitions, small_batches, store, table, text_of, tidy

DICTIONARY = 1e-6
DEPTH = 3
MIN = 2
MU = 4.0
MARGIN = 0.0
ADD = 0.1
CHUNK = 1_000_000
PART = 500_000
SPARE = 16
_RARE = 1 << 20  # ids of words outside the dictionary start here
_FLUSH = 2_500_000  # words that a task counts at once


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy()
    some = pc.binary_length(words).to_numpy() > 0  # white space at an end of a text leaves empty words
    if some.all():
        return words, sizes
    before = np.concatenate([[0], np.cumsum(some)])
    ends = np.cumsum(sizes)
    return words.filter(pa.array(some)), before[ends] - before[ends - sizes]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        counts = pc.value_counts(pa.chunked_array(held_back, pa.string()))
        return pa.RecordBatch.from_arrays([counts.field(0).cast(pa.binary()), counts.field(1)], names=["word", "c"])

    held_back, n = [], 0
    for batch in batches:
        words, _ = _words(batch.column(0))
        held_back.append(words)
        n += len(words)
        if n > _FLUSH:
            yield out()
            held_back, n = [], 0
    yield out()


@dataclass
class Vocabulary:
    """Frequent words with their counts; id 0 is the end, id i the i-th word."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int  # N, with ends
    distinct: int  # V, with the end
    ends: int

    @property
    def norm(self) -> float:
        return self.tokens + ADD * (self.distinct + 1)

    @property
    def kind(self) -> type:
        """Of counts."""
        return np.uint32 if self.tokens < 1 << 32 else np.uint64

    @property
    def bits(self) -> int:
        return min(60, math.ceil(math.log2(4 * self.tokens + 4)) + SPARE)


def vocabulary(counts: DataFrame, train_docs: int) -> Vocabulary:
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    tokens = int(total or 0) + train_docs
    frequent = counts.filter(F.col("c") >= max(1, math.ceil(DICTIONARY * tokens))).select("word", "c").toArrow()  # at most 1/DICTIONARY rows
    frequent = sorted(zip(frequent["c"].to_numpy().tolist(), frequent["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    return Vocabulary([w for _, w in frequent], np.array([c for c, _ in frequent], np.int64), tokens, int(distinct) + (train_docs > 0), train_docs)


def _pack(x: np.ndarray) -> bytes:
    """Numbers, compressed byte place by byte place."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), codec="zstd", asbytes=True)


def _unpack(blob: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    raw = pa.decompress(blob, decompressed_size=width * n, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _pack_words(words: pa.Array) -> bytes:
    """Words, which have no white space in them, with their bytes' number before them."""
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_buffer()
    return raw.size.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_words(blob: bytes) -> pa.Array:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=size, codec="zstd")
    whole = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, size], np.int32)), raw])
    return pc.split_pattern(whole, "\n").flatten()


def _hashes(words: pa.Array) -> np.ndarray:
    """44 bits of each word."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = words.buffers()[2].to_pybytes() if at[-1] else b""
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) >> 20 for a, b in zip(at, at[1:])], np.uint64)


_CHUNK = "chunk bigint, ids binary, rare int, hashes binary, lengths array<bigint>, held array<boolean>"
_CODED = f"{_CHUNK}, words binary, own binary, doc_ids array<bigint>, known array<bigint>, base array<double>"


def _encode(vocab, size: int):
    """A row for each chunk: the word ids of its documents, and its distinct words outside the
    dictionary in order of their hashes, with their numbers in training documents."""
    state: dict = {}

    def batch_of(docs: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        chunk = docs[0][0]
        doc_id, held, lengths, known, base, rare = (pa.concat_arrays(c) for c in list(zip(*docs))[1:])
        whole = np.concatenate(ids)
        rare = rare.dictionary_encode()
        hashes = _hashes(rare.dictionary)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        outside = np.flatnonzero(whole < 0)
        word = rank[rare.indices.to_numpy()]
        whole[outside] = _RARE + word
        train = np.repeat(~held.to_numpy(zero_copy_only=False), lengths.to_numpy())
        own = np.bincount(word, train[outside], len(order))
        blob = lambda x: pa.array([x], pa.binary())
        each = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
        columns = [pa.array([chunk], pa.int64()), blob(_pack(whole)), pa.array([len(order)], pa.int32()), blob(_pack(np.diff(hashes[order], prepend=np.uint64(0)))), each(lengths), each(held)]
        columns += [blob(_pack_words(rare.dictionary.take(pa.array(order)))), blob(_pack(own)), each(doc_id), each(known), each(base)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CODED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        if not state:
            state["words"] = pa.array(v.words, pa.binary()).view(pa.string())
            state["log"] = np.log10(np.concatenate([[v.ends], v.counts]) + ADD)
        docs, held_back, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words, sizes = _words(batch.column(3))
            lengths = sizes.astype(np.int64) + 1
            ends = np.cumsum(lengths)
            starts = ends - lengths
            found = pc.fill_null(pc.index_in(words, value_set=state["words"]), -2).to_numpy()
            rare = words.filter(pa.array(found < 0))
            is_word = np.ones(ends[-1], bool)
            is_word[ends - 1] = False
            ids = np.zeros(ends[-1], np.int64)
            ids[is_word] = found + 1  # below 0 outside the dictionary
            outside = np.flatnonzero(ids < 0)
            base = state["log"][ids]
            base[outside] = 0.0
            before = np.concatenate([[0], np.searchsorted(outside, ends)])
            known = sizes - np.diff(before) + (v.ends > 0)
            columns = [batch.column(1), batch.column(2), pa.array(lengths), pa.array(known, pa.int64()), pa.array(np.add.reduceat(base, starts))]
            a = 0
            while a < len(lengths):  # up to the document that fills the chunk
                b = min(len(lengths), int(np.searchsorted(ends, size - n + starts[a])) + 1)
                docs.append((batch.column(0)[a].as_py(), *(c.slice(a, b - a) for c in columns), rare.slice(before[a], before[b] - before[a])))
                held_back.append(ids[starts[a] : ends[b - 1]])
                n += int(ends[b - 1] - starts[a])
                a = b
                if n >= size:
                    yield batch_of(docs, held_back)
                    docs, held_back, n = [], [], 0
        if docs:
            yield batch_of(docs, held_back)

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs with a word more."""
    return _mix(run * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64) + np.uint64(1))


def _gains(own: np.ndarray, total: np.ndarray, shorter: np.ndarray, train: np.ndarray) -> np.ndarray:
    """What a context's occurrences, each left out, gain over its suffix."""
    left_out = (np.maximum(own - 1, 0) + MU * shorter) / (total - 1 + MU)
    return np.where(train, np.log(left_out / shorter), 0.0)


def _place(n: int) -> type:
    """The smaller of the types that hold places below ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` of unsigned numbers with their inverse, quicker: they are dealt by their highest
    eight bits, and each slice is sorted with the places in the bits that leaves free."""
    if len(keys) < 1000:
        return np.unique(keys, return_inverse=True)
    low = keys.min()
    keys = keys - low
    shift = max(0, int(keys.max()).bit_length() - 8)
    top = (keys >> np.uint64(shift)).astype(np.uint8)
    sizes = np.bincount(top, minlength=256)
    wide = int(sizes.max()).bit_length()
    if shift + wide > 64:
        u, inverse = np.unique(keys, return_inverse=True)
        return u + low, inverse
    order = np.argsort(top, kind="stable")
    ends = np.cumsum(sizes)
    starts = np.repeat(ends - sizes, sizes)
    # the highest eight bits, the same in a slice, may go
    mixed = (keys[order] << np.uint64(wide)) | (np.arange(len(keys)) - starts).astype(np.uint64)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        mixed[a:b].sort()
    mixed &= np.uint64((1 << wide) - 1)
    order = order[mixed.astype(np.int64) + starts]
    del mixed, starts
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    inverse = np.empty(len(keys), _place(len(keys)))
    inverse[order] = np.cumsum(first) - 1
    return keys[first] + low, inverse


def _regroup(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``keys`` that ``group`` names, in order, and the places of its entries among them."""
    named = np.zeros(len(keys), bool)
    named[group] = True
    used = np.flatnonzero(named)
    used = used[np.argsort(keys[used], kind="stable")]
    rank = np.empty(len(keys), group.dtype)
    rank[used] = np.arange(len(used))
    return keys[used], rank[group]


def _runs(ids: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that end at the places ``end``."""
    run = np.zeros(len(end), np.uint64)
    for i in range(n - 1, -1, -1):
        run = _longer(run, ids[end - i])
    return run


@dataclass
class Told:
    """What a chunk was told in its first rounds, in the order in which ``walk`` needs it: counts at
    the tokens, and which contexts are kept. With it these rounds need no hashes and no sorts again."""

    rounds: int = 0
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    read: int = 0
    new: list[np.ndarray] = field(default_factory=list)

    def next(self, n: int) -> np.ndarray:
        self.read += n
        return self.numbers[self.read - n : self.read].astype(float)

    def add(self, x: np.ndarray) -> None:
        self.new.append(x)



def walk(ids: np.ndarray, lengths: np.ndarray, train: np.ndarray, hashes: np.ndarray, met: np.ndarray | None, v: Vocabulary, told: Told) -> Generator:
    """The scoring of a chunk, ``met`` being the numbers of its words outside the dictionary. Yields
    questions of the rounds not in ``told``, lists of (is a test, hashes in order, places among them,
    addends or a function that gives them, which replays need not call), and is sent a list of answers
    for each: the totals over all chunks, or for tests whether they are above MARGIN. Last it yields
    the probability of every token."""
    starts = np.cumsum(lengths) - lengths
    far = np.ones(len(ids), bool)  # far enough from the document's start to have a context
    far[starts] = False
    train = np.repeat(train, lengths)
    unit = train.astype(float)
    known = np.concatenate([[v.ends], v.counts]).astype(float)
    short = lambda hashes: hashes >> np.uint64(64 - v.bits)
    rare = np.flatnonzero(ids >= _RARE)
    word = ids.copy()  # among the dictionary and then the chunk's other words
    word[rare] += len(known) - _RARE
    ids = ids.astype(np.uint64)
    symbols = np.uint64(_RARE) + hashes
    ids[rare] = symbols[word[rare] - len(known)]
    at = np.flatnonzero(far)
    if told.rounds > 0:
        met = told.next(len(hashes))
        n = np.concatenate([known, met])[word]
        at = at[n[at - 1] >= MIN]
        own = told.next(len(at))
    else:
        (own,) = yield [(False, *_distinct(short(_runs(ids, at, 2))), unit[at])]
        n = np.concatenate([known, met])[word]
        often = n[at - 1] >= MIN
        at, own = at[often], own[often]
        told.add(met)
        told.add(own)
    total = n[at - 1]
    p = (n + ADD) / v.norm
    best = p.copy()
    for k in range(1, DEPTH + 1):
        shorter = p[at]
        mine = (own + MU * shorter) / (total + MU)
        if k < DEPTH:
            n = np.zeros(len(ids))
            n[at] = own
            far[starts[lengths > k] + k] = False
            then = np.flatnonzero((n[:-1] >= MIN) & far[1:]) + 1
        if told.rounds > k:
            kept = told.next(len(at))
            counts = [told.next(len(then))] if k < DEPTH else []
        else:
            if k == 1:  # words are numbered
                keys = np.concatenate([np.arange(len(known), dtype=np.uint64), symbols])
                contexts = _regroup(short(_longer(np.zeros(len(keys), np.uint64), keys)), word[at - 1].astype(_place(len(keys))))
            else:
                contexts = _distinct(short(_runs(ids, at - 1, k)))
            ask = [(True, *contexts, partial(_gains, own, total, shorter, train[at]))]
            if k < DEPTH:
                ask.append((False, *_distinct(short(_runs(ids, then, k + 2))), unit[then]))
            del contexts
            kept, *counts = yield ask
            for x in (kept, *counts):
                told.add(x)
        kept = kept > 0
        best[at[kept]] = mine[kept]
        p[at] = mine
        if k < DEPTH:
            at, own, total = then, counts[0], n[then - 1]
    yield best


def _question(parts: list[tuple]):
    """Keys in order with their places, and a function from answers in that order to answers for each
    place asked about. The lowest bit of a key says whether it is a test; of either kind is one part."""
    keys = [(hashes << np.uint64(1)) | np.uint64(test) for test, hashes, _, _ in parts]
    if len(parts) == 1:
        keys, places = keys[0], [parts[0][2]]
    else:  # all keys are distinct, since tests are odd
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")  # merges what is in order
        keys = keys[order]
        rank = np.empty(len(keys), _place(len(keys)))
        rank[order] = np.arange(len(keys))
        places = [r[at] for r, (_, _, at, _) in zip(np.split(rank, np.cumsum(sizes)[:-1]), parts)]
    return keys, places, lambda answer: [answer[at] for at in places]


def _sums(parts: list[tuple], keys: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    addends = [x() if callable(x) else x for _, _, _, x in parts]
    s = np.bincount(np.concatenate(places), np.concatenate(addends), len(keys))
    return np.where(keys & np.uint64(1), s.astype(np.float32), s)  # tests need fewer digits


def _walked(row: dict, v: Vocabulary):
    """Takes a chunk on from what it was told, with the answers it has since: the next question's keys
    and sums, or at the end the tokens' probabilities, with the documents' lengths."""
    lengths = np.array(row["lengths"], np.int64)
    ids = _unpack(row["ids"], int(lengths.sum()), np.int64)
    told = row.get("told") or Told()
    hashes = np.cumsum(_unpack(row["hashes"], row["rare"], np.uint64)) if row.get("rare") else np.zeros(0, np.uint64)
    steps = walk(ids, lengths, ~np.array(row["held"], bool), hashes, row.get("met", np.zeros(0)), v, told)
    said = next(steps)
    got: dict = {}
    for a in sorted(row.get("answers") or [], key=lambda a: (a["round"], a["part"])):
        got.setdefault(a["round"], []).append(_unpack(a["totals"], a["n"], np.float64))
    for k in range(told.rounds, DEPTH + 1):
        keys, places, spread = _question(said)
        # a round in which a chunk asks nothing has no answers
        if k not in got and (len(keys) or k >= row["round"]):
            return keys, _sums(said, keys, places)
        said = steps.send(spread(np.concatenate(got[k]) if k in got else np.zeros(0)))
    return said, lengths


def _rows(batches: Iterator[pa.RecordBatch], round_: int, v: Vocabulary, parts: int) -> Iterator[dict]:
    """The chunks, one by one, each with what it was told (rows with a negative part) and the numbers
    of its words outside the dictionary (parts from ``parts`` on)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0] | {"round": round_, "told": Told()}
            answers = row.get("answers") or []
            told = sorted((a for a in answers if a["part"] < 0), key=lambda a: a["round"])
            if told:
                row["told"] = Told(told[-1]["round"], np.concatenate([_unpack(a["totals"], a["n"], v.kind) for a in told]))
            met = sorted((a for a in answers if a["part"] >= parts), key=lambda a: a["part"])
            row["met"] = np.concatenate([np.zeros(0), *(_unpack(a["totals"], a["n"], np.float64) for a in met)])
            row["answers"] = [a for a in answers if 0 <= a["part"] < parts and a["round"] >= row["told"].rounds]
            yield row


def _ask_words(row: dict, parts: int) -> Iterator[tuple]:
    """The words outside the dictionary are asked about as they are, by parts of their hashes."""
    hashes = np.cumsum(_unpack(row["hashes"], row["rare"], np.uint64))
    own = _unpack(row["own"], row["rare"], np.float64)
    words = _unpack_words(row["words"])
    part = ((hashes >> np.uint64(14)) * np.uint64(_word_parts(parts))) >> np.uint64(30)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        yield parts + int(part[a]), b - a, _pack(own[a:b]), _pack_words(words.slice(a, b - a))


def _word_parts(parts: int) -> int:
    return -(-parts // 2)


_ASKED = "chunk bigint, part bigint, n int, totals binary, keys binary"
_ANSWERED = "chunk bigint, round int, part bigint, n int, totals binary"


def _ask(vocab, round_: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for row in _rows(batches, round_, v, parts):
            keys, sums = _walked(row, v)
            cut = max(0, v.bits - 30)  # the highest 30 bits say the part
            part = ((keys >> np.uint64(cut + 1)) * np.uint64(parts)) >> np.uint64(v.bits - cut)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else [0]
            asked = [(int(part[a]), b - a, _pack(sums[a:b]), _pack(np.diff(keys[a:b], prepend=np.uint64(0)))) for a, b in zip(edges, edges[1:])]
            if round_:  # what it was told last goes along, as a part by itself
                told = np.concatenate(row["told"].new).astype(v.kind)
                asked.append((-1 - row["chunk"], len(told), _pack(told), b""))
            elif row["rare"]:
                asked += _ask_words(row, parts)
            part, n, totals, hashes = zip(*asked) if asked else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["chunk"]] * len(asked), pa.int64()), pa.array(part, pa.int64()), pa.array(n, pa.int32()), pa.array(totals, pa.binary()), pa.array(hashes, pa.binary())],
                names=["chunk", "part", "n", "totals", "keys"],
            )

    return run


def _total(round_: int, margin: float, parts: int | None = None):
    """Parts from ``parts`` on are of words."""

    def run(asked: pa.Table) -> pa.Table:
        sizes = asked["n"].to_pylist()
        if asked["part"][0].as_py() < 0:
            answers = asked["totals"]
        else:
            of_words = parts is not None and asked["part"][0].as_py() >= parts
            sums = np.concatenate([_unpack(s, n, np.float64) for s, n in zip(asked["totals"].to_pylist(), sizes)])
            if of_words:
                inverse = pa.concat_arrays([_unpack_words(k) for k in asked["keys"].to_pylist()]).dictionary_encode().indices.to_numpy()
                total = np.bincount(inverse, sums)[inverse]
            else:
                u, inverse = _distinct(np.concatenate([np.cumsum(_unpack(k, n, np.uint64)) for k, n in zip(asked["keys"].to_pylist(), sizes)]))
                total = np.bincount(inverse, sums, len(u))
                total = np.where(u & np.uint64(1), total > margin, total)[inverse]
            ends = np.cumsum(sizes).tolist()
            answers = pa.array([_pack(total[e - n : e]) for e, n in zip(ends, sizes)], pa.binary())
        return pa.table({"chunk": asked["chunk"], "round": pa.array([round_] * len(sizes), pa.int32()), "part": asked["part"], "n": asked["n"], "totals": answers})

    return run


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(vocab, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for row in _rows(batches, DEPTH + 1, v, parts):
            p, lengths = _walked(row, v)
            ends = np.cumsum(lengths)
            tree = np.add.reduceat(np.log10(p), ends - lengths)
            ids = _unpack(row["ids"], len(p), np.int64)
            rare = np.flatnonzero(ids >= _RARE)
            met = row["told"].numbers[: row["rare"]].astype(float)[ids[rare] - _RARE]
            doc = np.searchsorted(ends, rare, side="right")
            known = np.array(row["known"], np.int64) + np.bincount(doc[met > 0], minlength=len(ends))
            base = np.array(row["base"]) + np.bincount(doc, np.log10(met + ADD), len(ends)) - lengths * math.log10(v.norm)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(known), pa.array(base), pa.array(tree)],
                names=[c.split()[0] for c in _SCORED.split(", ")],
            )

    return run


def tree_scores(coded: DataFrame, vocab, parts: int, buckets: int) -> DataFrame:
    """Every document with its counts and scores; ``coded`` is bucketed by chunk."""
    chunk = [c.split()[0] for c in _CHUNK.split(", ")]
    answers: list[DataFrame] = []

    def answered(*more: str) -> DataFrame:
        chunks = coded.select(*chunk, *more)
        if not answers:
            return chunks
        every = answers[-1]
        for before in answers[:-1]:
            every = every.unionByName(before.filter("part < 0"))
        every = every.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("round", "part", "n", "totals")).alias("answers"))
        return chunks.join(every, "chunk", "left")

    for k in range(DEPTH + 1):
        asked = answered(*([] if k else ["words", "own"])).mapInArrow(tidy(_ask(vocab, k, parts)), _ASKED)
        answers.append(store(asked.groupBy("part").applyInArrow(_total(k, MARGIN, parts), _ANSWERED), f"round{k}"))
        if k == 1:  # nothing was told before it
            drop_stored(answers.pop(0))
    tree = store(answered("doc_ids", "known", "base").mapInArrow(tidy(_score(vocab, parts)), _SCORED), "tree")
    drop_stored(*answers)
    return tree


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document; the
    model learns from those that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    held = F.pmod(crc_of_id("doc_id"), F.lit(10)) == 0
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), text_of("text").cast("binary").alias("text"))
    train = rows.filter("not held_out")
    counts = store(train.select("text").mapInArrow(tidy(_count_words), "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")
    v = vocabulary(counts, train.count())
    drop_stored(counts)
    vocab = spark.sparkContext.broadcast(v)  # at most 1/DICTIONARY words
    buckets = min(100_000, max(partitions(spark), -(-v.tokens // CHUNK)))
    parts = max(1, -(-v.tokens // PART))
    name, path = f"gridloom_coded_{uuid.uuid4().hex}", new_path(spark, "coded")
    rows.mapInArrow(tidy(_encode(vocab, CHUNK)), _CODED).write.bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    coded = spark.table(name)
    coded._gridloom_path = path
    tree = tree_scores(coded, vocab, parts, buckets)
    spark.sql(f"DROP TABLE {name}")  # leaves the files
    drop_stored(coded)
    return tree.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op02_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_tree": op02_query}
ORACLE: dict[str, str] = {}
