"""Token ids in directly addressable codes.

Texts are encoded in ascending order of doc_id; the ids of consecutive documents form a segment.
A segment splits each id into chunks of 8 bits, lowest first: level 1 holds the first chunk of
every id, level 2 the second chunk of those ids that go on, and so forth. Each level carries a
bitmap of the entries that go on and a rank directory (the ones before every 512th bit), so that
id i is found by one byte and one rank a level, without decoding any other id.

The file format is Parquet, uncompressed, one row a segment, through Spark's own committers: a
task that is lost and run again leaves no double rows, and any store that Spark reaches will do.
Columns: part, seg (order), start (ids before it within its part), n, doc_ids, doc_lens (ids of
each document with its end id), levels (array of chunks, more, ranks).

At scale: one range shuffle of the texts by doc_id; a task holds one segment at a time. The driver
sees one total for each written partition.

Defined results: null text is empty text, which has the end id only; null doc_ids come first;
repeated doc_ids stand in the order of their texts; an empty table gives an empty file and result;
further columns are ignored. Text that looks like a special token is left to the tokenizer.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import new_path, partitions, small_batches, table, text_of

END_ID = 2
SEGMENT_IDS = 16_384
_RANK_BITS = 512
_LEVEL = "struct<chunks: binary, more: binary, ranks: binary>"
SCHEMA = f"part int, seg bigint, start bigint, n bigint, doc_ids array<bigint>, doc_lens array<bigint>, levels array<{_LEVEL}>"
_CACHE = 600_000
_REST = 200_000
#: What the tokenizer, or an older table of white space, might take for white space.
_BLANK = r"\s\u180e\u200b\u2060\ufeff"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_POINT = r""".,;:!?|#$%&*()"-"""
# The tokenizer's words never hold a character of no white space followed by white space, nor a
# letter next to one of these points, so a text may be cut there and its pieces encoded apart.
_AT_SPACE = re.compile(f"(?<=[^{_BLANK}])(?= )")
_IN_PIECE = re.compile(f"(?<=[{_LETTER}])(?=[{_POINT}])|(?<=[{_POINT}])(?=[{_LETTER}])|(?<=[^{_BLANK}])(?=\n)")
_STEM = re.compile(f" [^{_BLANK}]+")
_ODD_START = re.compile(f"[{_BLANK}]")
_ODD_END = re.compile(f"[{_BLANK}]$")


class Encoder:
    """Ids of a text as little-endian 32-bit bytes; frequent pieces are looked up, not encoded again."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        #: pieces after a space, by their text without it; all other pieces
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.long = False

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _other(self, piece: str) -> bytes:
        code = self.rest.get(piece)
        if code is None:
            code = self._plain([piece])[0].tobytes() if piece else b""
            if len(piece) < 32:
                if len(self.rest) > _REST:
                    self.rest.clear()
                self.rest[piece] = code
        return code

    def _others(self, pieces: list[str]) -> None:
        if len(self.rest) > _REST:
            self.rest.clear()
        for at in range(0, len(pieces), 1024):
            some = pieces[at : at + 1024]
            for piece, ids in zip(some, self._plain(some)):
                if len(piece) < 32:
                    self.rest[piece] = ids.tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words as they stand after a space, many in one string: each begins with the only
        spaced token it has."""
        new = self.new
        for at in range(0, len(words), 1024):
            some = words[at : at + 1024]
            ids = self._plain([" " + " ".join(some)])[0]
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(some):
                code, edges = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                new.update(zip(some, [code[x:y] for x, y in zip(edges, edges[1:])]))
            else:
                for word, own in zip(some, self._plain([" " + w for w in some])):
                    new[word] = own.tobytes()

    def _fill(self, missing: set[str]) -> None:
        """Have all pieces but the odd ones, after which a space is no place to cut."""
        new, old = self.new, self.old
        again = missing & old.keys()
        new.update(zip(again, map(old.__getitem__, again)))
        missing -= again
        self.long = self.long or max(map(len, missing), default=0) >= 64
        words = [p for p in missing if p.isalpha()]
        stems, pointed, cut, lines = set(words), [], {}, []
        for piece in missing.difference(words):
            if piece[:1] == "\n":
                # begins a line and follows no space
                if len(piece) == 1 or not (_ODD_START.match(piece, 1) or _ODD_END.search(piece)):
                    lines.append(piece)
            elif piece[-1:] in (".", ",") and piece[:-1].isalpha() and piece[-2] < "\u0100":
                pointed.append(piece)
                if piece[:-1] not in new:
                    stems.add(piece[:-1])
            elif piece and not _ODD_END.search(piece):
                parts = cut[piece] = _IN_PIECE.split(" " + piece)
                if parts[0][1:] not in new and _STEM.fullmatch(parts[0]):
                    stems.add(parts[0][1:])
        self._learn(list(stems))
        first = {p[1:-1] if p[-1] in ".,-" and p[1:-1].isalpha() and p[-2] < "\u0100" else p[1:] for p in lines}
        self._others([x for x in first if x not in self.rest])
        line = self._other("\n")
        for piece in lines:
            word = piece[1:-1]
            code = self._other(word) + self._other(piece[-1]) if word in first and piece[-1] in ".,-" and word.isalpha() and piece[-2] < "\u0100" else self._other(piece[1:])
            new[piece] = line + code
        point = {x: self._other(x) for x in ".,"}
        for piece in pointed:
            new[piece] = new[piece[:-1]] + point[piece[-1]]
        for piece, parts in cut.items():
            if piece not in new:
                head = new[parts[0][1:]] if parts[0][1:] in new else self._other(parts[0])
                new[piece] = head + b"".join([self._other(x) for x in parts[1:]])

    def __call__(self, texts: list[str]) -> list[bytes]:
        get, rows, missing = self.new.get, [], set()
        for whole in texts:
            text = whole
            if "\n" in text:
                if "\n\n" in text or " \n" in text or "\n " in text:
                    rows.append((whole, None, None, None))
                    continue
                # a single line end is a word of its own, so a line can begin a piece
                text = text.replace("\n", " \n")
            pieces = text.split(" ")
            codes = list(map(get, pieces))
            codes[0] = b""  # follows no space
            gaps = [i for i, c in enumerate(codes) if c is None] if None in codes else ()
            if gaps:
                missing.update([pieces[i] for i in gaps])
            rows.append((whole, pieces, codes, gaps))
        self._fill(missing)
        new, out = self.new, []
        for text, pieces, codes, gaps in rows:
            if any(s in text for s in self.special):
                out.append(self._plain([text])[0].tobytes())
                continue
            try:
                if pieces is None or _ODD_END.search(pieces[0]):
                    raise KeyError
                codes[0] = self._other(pieces[0])
                for i in gaps:
                    codes[i] = new[pieces[i]]
                out.append(b"".join(codes))
            except KeyError:  # an odd piece
                out.append(b"".join([self._other(x) for x in _AT_SPACE.split(text)]))
        if len(new) > _CACHE:
            self.old = {k: v for k, v in new.items() if len(k) < 64} if self.long else new
            self.new, self.long = {}, False
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of directly addressable codes for unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[np.arange(0, len(rest) + 1, _RANK_BITS)]
        levels.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ones.astype("<u4").tobytes()})
        rest = rest[more] >> 8
    return levels


def unpack(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment."""
    out = None
    for level in reversed(levels):
        chunks = np.frombuffer(level["chunks"], np.uint8).astype("<u4")
        if out is not None:
            more = np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(chunks), bitorder="little").astype(bool)
            chunks[more] |= out << 8
        out = chunks
    return out


def token_at(levels: list[dict[str, bytes]], i: int) -> int:
    """Id i alone: one chunk, one bit and one rank a level."""
    value = shift = 0
    for level in levels:
        value |= level["chunks"][i] << shift
        more = level["more"]
        if not more[i >> 3] >> (i & 7) & 1:
            break
        block = i // _RANK_BITS
        rank = int(np.frombuffer(level["ranks"], "<u4", 1, 4 * block)[0])
        lead = int.from_bytes(more[block * _RANK_BITS // 8 : (i >> 3) + 1], "little") & ((1 << (i - block * _RANK_BITS)) - 1)
        i, shift = rank + lead.bit_count(), shift + 8
    return value


def _segments(path: str, end_id: int, segment_ids: int):
    end = np.array([end_id], "<u4").tobytes()
    kinds = [("part", pa.int32()), ("seg", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64()))]
    level = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
    shape = pa.schema([*kinds, ("levels", pa.list_(level))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seg, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            lens = [len(x) // 4 for x in parts]
            row = {"part": part, "seg": seg, "start": start, "n": held, "doc_ids": ids, "doc_lens": lens, "levels": pack(np.frombuffer(b"".join(parts), "<u4"))}
            return pa.RecordBatch.from_pylist([row], schema=shape)

        gc.disable()  # millions of short-lived lists and strings, none of them in a cycle
        try:
            for batch in batches:
                doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for doc_id, code in zip(doc_ids, encode(texts)):
                    ids.append(doc_id)
                    parts.append(code + end)
                    held += len(parts[-1]) // 4
                    if held >= segment_ids:
                        yield segment()
                        seg, start, held, ids, parts = seg + 1, start + held, 0, [], []
            if ids:
                yield segment()
        finally:  # the worker goes on to other tasks, also if this one is killed
            gc.enable()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all texts in ascending doc_id order and write them to ``path``."""
    small_batches(docs.sparkSession, 2000, 16)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of("text").alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    rows.mapInArrow(_segments(tokenizer, end_id, segment_ids), SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for row in batch.to_pylist():
            ids, at = unpack(row["levels"]), 0
            for doc_id, n in zip(row["doc_ids"], row["doc_lens"]):
                for col, v in zip(out, (doc_id, row["start"] + at, n, zlib.crc32(ids[at : at + n].tobytes()))):
                    col.append(v)
                at += n
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, at = [], 0
    for part, n in totals:
        before.append((part, at))
        at += n
    # one row a written partition, as many as the write had tasks
    parts = F.broadcast(spark.createDataFrame(before, "part int, before bigint"))
    rows = segments.join(parts, "part").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "doc_lens", "levels")
    return rows.mapInArrow(_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op08_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)


QUERIES = {"op8_direct_codes": op08_query}
ORACLE: dict[str, str] = {}
