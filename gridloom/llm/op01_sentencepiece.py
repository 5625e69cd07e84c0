"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces runs once over a text. At each position its output links
give every piece that ends there, longest first, and each relaxes the best score of that position
from the best score of the position where it starts; a character of no piece costs the lowest
score less 10 and becomes its UTF-8 bytes. This is the library's unigram search.

Scores: a unigram model's own. A BPE model holds merge ranks, which are no log probabilities;
``scores="zipf"`` (the default for such a model) takes -log(rank + 10), ``scores="model"`` the
stored numbers. Segmentations therefore differ from the library's merge encoder on such a model.

White space: a space is U+2581, one is put before the text, as the model asks. A U+2581 of the text
itself is written as bytes, so decoding returns every text exactly. Only models with the identity
normaliser are read.

A text is searched in pieces between cuts that no vocabulary piece can span (checked when the model
is read), so the best path of a text is the best paths of its pieces; frequent ones are kept.

Defined results: null text is empty text and has no ids; null and repeated doc_ids are documents
like others; long texts take memory in proportion to their own length; an empty table gives an
empty result; further columns are ignored. No shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, table, text_of, tidy

_MARK = "▁"
_UNKNOWN_COST = 10.0
_CACHE = 100_000
_PLAIN = re.compile(r" *[^ \n]+| +|\n")


class PieceModel:
    """Pieces, scores and the automaton of a SentencePiece model file."""

    def __init__(self, path: str, scores: str | None = None):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode("ﬁ①  x") and sp.decode(sp.encode("ﬁ①  x")) != "ﬁ①  x":
            raise ValueError("only models with the identity normaliser are supported")
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in plain}
        if scores is None:
            scores = "zipf" if all(s == int(s) for s in score.values()) else "model"
        if scores == "zipf":
            score = {i: -math.log(k + 10.0) for k, i in enumerate(sorted(plain, key=lambda i: (-score[i], i)))}
        self.score = score
        self.unknown = min(score.values()) - _UNKNOWN_COST
        self.unknown_id = sp.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), score[i]))
        self.automaton.make_automaton()
        self.single = {self.pieces[i] for i in plain if len(self.pieces[i]) == 1}
        # may a text be cut before a mark that follows another character, and around a line end?
        self.cuts = not any("\n" in p or re.search(f"[^{_MARK}]{_MARK}", p) for p in (self.pieces[i] for i in plain))
        self.text = [p.replace(_MARK, " ") for p in self.pieces]
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                self.text[i] = ""
        for b, i in self.bytes.items():
            if b < 0x80:
                self.text[i] = chr(b)
        self.high = np.zeros(n, bool)
        self.high[[i for b, i in self.bytes.items() if b >= 0x80]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown_id]

    def best_path(self, text: str) -> list[int]:
        """Ids of the best segmentation of ``text``, in which spaces are marks already."""
        n, single, unknown = len(text), self.single, self.unknown
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        filled = 0
        for end, (piece, length, score) in self.automaton.iter(text):
            while filled < end:
                filled += 1
                if text[filled - 1] not in single and best[filled - 1] + unknown > best[filled]:
                    best[filled], back[filled] = best[filled - 1] + unknown, (filled - 1, -1)
            start = end + 1 - length
            if best[start] + score > best[end + 1]:
                best[end + 1], back[end + 1] = best[start] + score, (start, piece)
        while filled < n:
            filled += 1
            if text[filled - 1] not in single and best[filled - 1] + unknown > best[filled]:
                best[filled], back[filled] = best[filled - 1] + unknown, (filled - 1, -1)
        steps, at = [], n
        while at:
            start, piece = back[at]
            steps.append((start, piece))
            at = start
        out: list[int] = []
        for start, piece in reversed(steps):
            if piece < 0:
                out += self._fallback(text[start])
            else:
                out.append(piece)
        return out

    def _piece(self, chunk: str) -> bytes:
        code = self.new.get(chunk)
        if code is None:
            code = self.old.get(chunk)
            if code is None:
                code = np.array(self.best_path(chunk.replace(" ", _MARK)), "<i4").tobytes()
            if len(chunk) < 64:
                self.new[chunk] = code
        return code

    def _part(self, text: str) -> bytes:
        chunks = _PLAIN.findall(text) if self.cuts else [text]
        new = self.new
        try:
            return b"".join([new[c] for c in chunks])
        except KeyError:
            return b"".join([self._piece(c) for c in chunks])

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.array([], "<i4")
        if len(self.new) > _CACHE:
            self.old, self.new = self.new, {}
        text = " " + text
        if _MARK not in text:
            return np.frombuffer(self._part(text), "<i4")
        mark = np.array(self._fallback(_MARK), "<i4").tobytes()
        return np.frombuffer(mark.join(self._part(p) if p else b"" for p in text.split(_MARK)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        if not self.high[ids].any():
            text = "".join(map(self.text.__getitem__, ids.tolist()))
        else:
            out, held = [], bytearray()
            for i in ids.tolist():
                if i in self.of_byte:
                    held.append(self.of_byte[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                out.append(self.text[i])
            out.append(held.decode("utf-8", "replace"))
            text = "".join(out)
        return text[1:] if text.startswith(" ") else text


_models: dict[tuple, PieceModel] = {}


def model(path: str, scores: str | None = None) -> PieceModel:
    """The model of a file, read once by each worker."""
    if (path, scores) not in _models:
        _models[path, scores] = PieceModel(path, scores)
    return _models[path, scores]


def encode(docs: DataFrame, path: str, scores: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ids array<int>, n_tokens, round_trip (decoding the ids gives the text)."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, text_of("text").alias("gl_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "ids array<int>, n_tokens bigint, round_trip boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, scores)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            codes = [m.encode(t) for t in texts]
            sizes = np.array([len(c) for c in codes], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*codes, np.array([], np.int32)]).astype(np.int32)))
            same = pa.array([m.decode(c) == t for c, t in zip(codes, texts)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids, pa.array(sizes), same], names=[*keep, "ids", "n_tokens", "round_trip"])

    return rows.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of ``ids``; null ids are no ids."""
    rows = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("gl_ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(np.array(x, np.int32)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(tidy(run), schema)


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as ids: doc_id, lang, source, ids, n_tokens, round_trip."""
    return encode(docs, _path(), keep=("doc_id", "lang", "source"))


def op01_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), _path())


QUERIES = {"op1_sentencepiece": op01_query}
ORACLE: dict[str, str] = {}
