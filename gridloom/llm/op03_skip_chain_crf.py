"""Personal data by a skip-chain conditional random field on top of fixed patterns.

Base spans are the leftmost non-overlapping matches of four patterns, checked afterwards (parts of
an address, Luhn sum, number of digits). They stay. The field looks at every other stretch that could
be such data, numbers and spelled-out addresses, with or without base spans in its document: its
nodes are these stretches and the base spans in order, with the labels none, email, ip, card, phone;
neighbours share a chain potential, and stretches with the same address, the same four parts of an
IP address or the same digits (the last nine of longer numbers), however far apart and whether a
pattern has found them or not, share a skip potential. Loopy belief propagation over the whole
document makes their labels agree. A stretch whose label is none with less than 1 - ADD_AT is added:
a number that repeats a base span in another form, but also one that looks like the forms in which
the field has seen personal data hide.

Weights are fitted by pseudo-likelihood, in numpy, on the stretches of about TRAIN_DOCS documents (a
bounded sample; of more than NODES stretches those that come first in a hash order). Base labels are
partly hidden there: every base span also stands in the sample in a disguise that no pattern finds
(without its plus sign, with other separators, spelled out), half of the time linked to the span it
repeats and half of the time alone, so the field learns both to follow a link and to label a stretch
that stands by itself. Stretches that no pattern finds count as none. Everything else covers all rows
and whole texts.

At scale: one scan for the sample and one for the work, no shuffle; memory grows with the longest
text. Repeated stretches are linked in a row, not pairwise, so a number that stands a thousand
times makes 999 links.

Defined results: null text is empty text, without spans; null and repeated doc_ids are documents
like others; an empty table gives an empty result; further columns are ignored. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, table, text_of

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 10_000
NODES = 60_000
ADD_AT = 0.7
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match from inside a run of digits would also match from its start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"\(?[0-9](?:(?:[-./_]|\) ?| \(?)?[0-9])+")
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?\[at\] ?| ?\(at\) ?| at )[A-Za-z0-9-]++(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )[A-Za-z0-9-]++)+", re.IGNORECASE)
#: What a spelled-out address needs.
_AT = re.compile(r"[\[(]at[\])]| at ", re.IGNORECASE)
_DOT = re.compile(r"[\[(]dot[\])]| dot ", re.IGNORECASE)
_LETTER = re.compile("[A-Za-z]")
_SEPARATOR = re.compile("[-./_ ]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind, then start."""
    out = []
    pos = floor = 0
    at = text.find("@")
    while at >= 0:
        local = text[max(pos, floor) : at]
        start = max(pos, floor) + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            pos = m.end()
        floor = at + 1
        at = text.find("@", max(pos, floor))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


FEATURES = 41
_PLAIN_AT = 39


def _quad(piece: str) -> str | None:
    """The four parts of an IP address, if the stretch is four numbers up to 255."""
    parts = [p.lstrip("0") or "0" for p in _SEPARATOR.split(piece)]
    return ".".join(parts) if len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) else None


def _features(piece: str, before: str = "", after: str = "") -> list[int]:
    """Of a stretch and the characters around it: positions of the features that hold."""
    digits = _NOT_DIGIT.sub("", piece)
    letters = bool(_LETTER.search(piece))
    bracket, dot = "[" in piece or (letters and "(" in piece), bool(_DOT.search(piece))
    on = [0, 1 + min(len(digits), 20), 22 + min(piece.count("."), 4)]
    flags = (
        piece.startswith("+") or before == "+",
        "(" in piece,
        "-" in piece,
        " " in piece,
        "/" in piece or "_" in piece,
        16 <= len(digits) <= 19 and luhn(digits),
        not letters and _quad(piece) is not None,
        "@" in piece,
        letters,
        digits.startswith("0"),
        bracket,
        dot,
        letters and "@" not in piece and not bracket and not dot,
        not letters and (before.isalnum() or after.isalnum()),
    )
    return on + [27 + k for k, f in enumerate(flags) if f]


def _disguise(piece: str, label: int, turn: int) -> str:
    """The same data in a form that no pattern finds."""
    if label == 1:
        at, dot = ((" [at] ", "."), (" at ", " dot "), ("(at)", "(dot)"))[turn % 3]
        local, _, domain = piece.partition("@")
        return local + at + domain.replace(".", dot)
    if label == 2:
        return piece.replace(".", "-_/"[turn % 3])
    digits = _NOT_DIGIT.sub("", piece)
    if label == 3:
        return "./_"[turn % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    bare = piece.lstrip("+")
    return (bare, re.sub("[() .-]+", ".", bare).strip("."), re.sub("[() .-]+", "-", bare).strip("-"))[turn % 3]


def _likeness(text: str, start: int, end: int) -> list[str]:
    """Stretches that share a key are linked."""
    piece = text[start:end].lower()
    if re.search("[a-z]", piece):
        piece = re.sub(r" ?[\[(]at[\])] ?| at ", "@", piece)
        return ["a" + re.sub(r" ?[\[(]dot[\])] ?| dot ", ".", piece)]
    quad = _quad(piece)
    keys = ["i" + quad] if quad else []
    digits = _NOT_DIGIT.sub("", piece)
    # few digits of an address are no number
    return [*keys, "d" + digits[-9:]] if len(digits) >= (9 if keys and "." in piece else 7) else keys


class Graph:
    """Nodes of one document: spans, labels (0: none, -1: open), features, and their links."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        nodes = [(a, b, k + 1) for k, a, b in base]
        taken = sorted((a, b) for a, b, _ in nodes)
        free = [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7]
        if _AT.search(text):
            free += [m.span() for m in _SPELT.finditer(text)]
        k = 0
        for a, b in sorted(free):
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            # one step back as well: base spans of two kinds may overlap
            if not any(x < b and a < y for x, y in taken[max(0, k - 2) : k + 2]):
                nodes.append((a, b, -1))
        nodes.sort()
        self.nodes = nodes
        self.chain = [(i, i + 1) for i in range(len(nodes) - 1)]
        alike: dict[str, list[int]] = {}
        for i, (a, b, _) in enumerate(nodes):
            for key in _likeness(text, a, b):
                alike.setdefault(key, []).append(i)
        self.skip = [e for same in alike.values() for e in zip(same, same[1:])]
        self.text = text

    def features(self) -> list[list[int]]:
        return [_features(self.text[a:b], self.text[a - 1 : a] if a else "", self.text[b : b + 1]) for a, b, _ in self.nodes]


class Field:
    """Weights: node (5 x FEATURES), chain (5 x 5: before, after), skip (5 x 5)."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    def marginals(self, g: Graph, rounds: int = 40, damp: float = 0.3) -> np.ndarray:
        n = len(g.nodes)
        phi = np.array([self.node[:, f].sum(axis=1) for f in g.features()])
        for i, (_, _, label) in enumerate(g.nodes):
            if label >= 0:
                phi[i] = -50.0
                phi[i, label] = 0.0
        edges = [(i, j, self.chain) for i, j in g.chain] + [(i, j, self.skip) for i, j in g.skip]
        if not edges:
            return np.exp(phi - np.logaddexp.reduce(phi, axis=1, keepdims=True))
        src = np.array([e for i, j, _ in edges for e in (i, j)])
        dst = np.array([e for i, j, _ in edges for e in (j, i)])
        psi = np.array([m for _, _, w in edges for m in (w, w.T)])
        msg = np.zeros((len(src), 5))
        back = np.arange(len(src)) ^ 1
        for _ in range(rounds):
            into = phi.copy()
            np.add.at(into, dst, msg)
            out = into[src] - msg[back]
            new = np.logaddexp.reduce(out[:, :, None] + psi, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            step = (1 - damp) * new + damp * msg
            moved = np.abs(step - msg).max()
            msg = step
            if moved < 1e-6:
                break
        belief = phi.copy()
        np.add.at(belief, dst, msg)
        p = np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))
        assert p.shape == (n, 5)
        return p

    def added(self, text: str, base: list[tuple[int, int, int]], add_at: float = ADD_AT) -> list[tuple[int, int, int]]:
        g = Graph(text, base)
        if all(label >= 0 for _, _, label in g.nodes):
            return []
        p = self.marginals(g)
        return [(int(p[i, 1:].argmax()), a, b) for i, (a, b, label) in enumerate(g.nodes) if label < 0 and p[i, 0] < 1 - add_at]


def fit(rows: list[tuple[list[int], int, int, int, list[int]]], steps: int = 2000, rate: float = 0.5, decay: float = 2e-3) -> Field:
    """Pseudo-likelihood: each row has a node's features, its label, the labels before and after
    (-1: none) and those of its skip neighbours."""
    n = len(rows)
    x = np.zeros((n, FEATURES + 15))
    y = np.zeros(n, int)
    for r, (features, label, before, after, skips) in enumerate(rows):
        x[r, features] = 1
        y[r] = label
        if before >= 0:
            x[r, FEATURES + before] = 1
        if after >= 0:
            x[r, FEATURES + 5 + after] = 1
        for s in skips:
            x[r, FEATURES + 10 + s] += 1
    w = np.zeros((5, x.shape[1]))
    # without evidence, equal stretches prefer equal labels, and a word, "at" and a name are no address
    w[:, FEATURES + 10 :] = 4.0 * np.eye(5)
    w[0, [0, _PLAIN_AT]] = 1.0, 4.0
    prior = w.copy()
    if n:
        target = np.eye(5)[y]
        for _ in range(steps):
            z = x @ w.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w -= rate * ((p - target).T @ x / n + decay * (w - prior))
    before, after = w[:, FEATURES : FEATURES + 5], w[:, FEATURES + 5 : FEATURES + 10]
    skip = w[:, FEATURES + 10 :]
    return Field(w[:, :FEATURES], (before.T + after) / 2, (skip + skip.T) / 2)


_NODE = pa.schema([("f", pa.list_(pa.int32())), ("y", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("skips", pa.list_(pa.int32()))])


def training_nodes(text: str) -> list[dict]:
    """Features, label, neighbours' labels (-1: none) and skip neighbours' labels of a document's
    stretches; base spans also in a disguise, as a repeated stretch or alone."""
    g = Graph(text, base_spans(text))
    labels, skips = [max(label, 0) for _, _, label in g.nodes], [[] for _ in g.nodes]
    for i, j in g.skip:
        skips[i].append(labels[j])
        skips[j].append(labels[i])
    out = []
    for i, f in enumerate(g.features()):
        start, end, label = g.nodes[i]
        before, after = labels[i - 1] if i else -1, labels[i + 1] if i + 1 < len(labels) else -1
        out.append({"f": f, "y": labels[i], "before": before, "after": after, "skips": skips[i]})
        if label > 0:
            turn = zlib.crc32(text[start:end].encode())
            hidden = _features(_disguise(text[start:end], label, turn // 2))
            if turn % 2:  # it repeats the span, which is the stretch before it
                out.append({"f": hidden, "y": label, "before": label, "after": after, "skips": [label]})
            else:
                out.append({"f": hidden, "y": label, "before": before, "after": after, "skips": []})
    return out


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([row for text in batch.column(0).to_pylist() for row in training_nodes(text)], schema=_NODE)


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, nodes: int = NODES) -> Field:
    """Fit on the stretches of about ``train_docs`` documents, at most ``nodes`` of them."""
    every = max(1, docs.count() // train_docs)
    sample = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(every)) == 0).select(text_of("text").alias("text"))
    names = ["f", "y", "before", "after", "skips"]
    rows = sample.mapInArrow(_training_rows, "f array<int>, y int, before int, after int, skips array<int>")
    # a top-k in an order that does not depend on partitions
    rows = rows.orderBy(F.xxhash64(*names), *names).limit(nodes).collect()
    return fit([(r["f"], r["y"], r["before"], r["after"], r["skips"]) for r in rows])


def find(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base (array of struct kind, start, end) and added (likewise)."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, text_of("text").alias("gl_text"))
    span = "array<struct<kind: string, `start`: bigint, `end`: bigint>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"base {span}, added {span}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for text in batch.column(len(keep)).to_pylist():
                found = base_spans(text)
                base.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(found)])
                added.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(field.added(text, found))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(base, kind), pa.array(added, kind)], names=[*keep, "base", "added"])

    return rows.mapInArrow(run, schema)


def op03_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = find(docs, train(docs))
    place = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(place[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda name: lambda s: s["kind"] == name
    counts = [F.size(F.filter("every", of(name))).cast("bigint").alias(f"n_{name}") for name in KINDS]
    return found.withColumn("every", every).select("doc_id", *counts, F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("every")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


QUERIES = {"op3_skip_chain_crf": op03_query}
ORACLE: dict[str, str] = {}
