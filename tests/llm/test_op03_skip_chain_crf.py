import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import op03_skip_chain_crf as m

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for x in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", x[0])
            odd = sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in x[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and odd % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, *x.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a.@_-+() 0123459é%"), max_size=60) | st.text(alphabet=st.sampled_from("a@.b_"), max_size=25))
def test_base_is_the_patterns(text):
    assert m.base_spans(text) == plain(text)


def test_documents(spark, documents):
    rows = m.op03_query(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        said = m.joined(base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
        assert sum(r[f"n_{k}"] for k in m.KINDS) == len(base) + r["n_added"]


def test_repeats_take_the_label_of_what_they_repeat(documents):
    field = m.train(documents)
    hit = {
        "call +1 (487) 555-7209 now, or later (487) 555-7209 again": (3, "(487) 555-7209"),
        "card 4417 7442 8035 1547 and once more 4417.7442.8035.1547 there": (2, "4417.7442.8035.1547"),
        "write to jo.doe@mail.org, that is jo.doe at mail dot org, please": (0, "jo.doe at mail dot org"),
        "write to jo.doe@mail.org, that is jo.doe [at] mail [dot] org, please": (0, "jo.doe [at] mail [dot] org"),
    }
    for text, (kind, piece) in hit.items():
        base = m.base_spans(text)
        assert len(base) == 1, text
        a = text.rindex(piece)
        assert field.added(text, base) == [(kind, a, a + len(piece))], text
    for text in ["ref 9807915762804490 twice 9807915762804490", "in 1994 and 1995 it was 1234567 or 1234567", "we look at example.com here", ""]:
        assert field.added(text, m.base_spans(text)) == []


def test_many_repeats_and_long_texts(documents):
    field = m.train(documents)
    text = "+1 (487) 555-7209 " + "x (487) 555-7209 " * 3000
    assert len(field.added(text, m.base_spans(text))) == 3000
    assert m.base_spans("9" * 200_000 + " " + "a" * 200_000 + "@") == []


def test_odd_rows(odd, empty):
    field = m.train(odd)
    rows = m.find(odd, field).collect()
    assert len(rows) == odd.count()
    assert {s["kind"] for r in rows if r["doc_id"] == 7 for s in r["base"]} >= {"email", "phone", "ip"}
    assert m.find(empty, m.train(empty)).count() == 0


def test_short_numbers_and_long_addresses_are_linked(documents):
    field = m.train(documents)
    name, host = "n" * 70, "h" * 70
    hit = {
        "call +1234 5678 now, or later 1234 5678 again": (3, "1234 5678"),
        "from 10.1.2.34 and once more 10-1-2-34 there": (1, "10-1-2-34"),
        f"write to {name}@{host}.org, that is {name} at {host} dot org, please": (0, f"{name} at {host} dot org"),
    }
    for text, (kind, piece) in hit.items():
        base = m.base_spans(text)
        assert len(base) == 1, text
        a = text.rindex(piece)
        assert (a, a + len(piece)) in [m.Graph(text, base).nodes[i][:2] for e in m.Graph(text, base).skip for i in e], text
        assert field.added(text, base) == [(kind, a, a + len(piece))], text


def _corpus(documents):
    return [r["text"] or "" for r in documents.collect()]


def test_hidden_labels_are_found_again(documents):
    """Base spans in disguise, alone and repeating the span they stand for; and in a
    form that only the skip link can tell."""
    field = m.train(documents)
    bare = m.Field(field.node, field.chain, np.zeros((5, 5)))
    alone = linked = total = 0
    new = {"linked": 0, "without": 0, "total": 0}
    for text in _corpus(documents):
        for k, a, b in m.base_spans(text):
            piece = text[a:b]
            hidden = m._disguise(piece, k + 1, len(piece))
            total += 1
            one = f"see {hidden} there"
            alone += (k, 4, 4 + len(hidden)) in field.added(one, m.base_spans(one))
            two = f"see {piece} there, and {hidden} there"
            linked += (k, two.rindex(hidden), two.rindex(hidden) + len(hidden)) in field.added(two, m.base_spans(two))
            if k == 3:
                digits = re.sub("[^0-9]", "", piece)[1:]
                two = f"see {piece} there, and {digits} there"
                want, base = (k, two.rindex(digits), len(two) - 6), m.base_spans(two)
                new["total"] += 1
                new["linked"] += want in field.added(two, base)
                new["without"] += want in bare.added(two, base)
    assert total > 10 and alone >= 0.8 * total and linked >= 0.95 * total, (total, alone, linked)
    assert new["without"] == 0 and new["linked"] == new["total"] > 0, new


def test_the_field_runs_wherever_there_are_candidates(documents):
    field, seen = m.train(documents), []

    class Spy(m.Field):
        def marginals(self, g, **kw):
            seen.append(g.text)
            return super().marginals(g, **kw)

    spy = Spy(field.node, field.chain, field.skip)
    want = []
    for text in _corpus(documents):
        base = m.base_spans(text)
        spy.added(text, base)
        if any(label < 0 for _, _, label in m.Graph(text, base).nodes):
            want.append(text)
    assert seen == want and want


def _enumerated(field, g):
    """Marginals by the sum over all labellings."""
    phi = np.array([field.node[:, f].sum(axis=1) for f in g.features()])
    p = np.zeros((len(g.nodes), 5))
    for labels in itertools.product(range(5), repeat=len(g.nodes)):
        if all(n[2] in (-1, x) for n, x in zip(g.nodes, labels)):
            w = sum(phi[i, x] for i, x in enumerate(labels)) + sum(field.chain[labels[i], labels[j]] for i, j in g.chain) + sum(field.skip[labels[i], labels[j]] for i, j in g.skip)
            for i, x in enumerate(labels):
                p[i, x] += np.exp(w)
    return p / p.sum(axis=1, keepdims=True)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    for text, near in (("1234567 and 7654321 and 2468135 and 1357924", 1e-6), ("call +1 (487) 555-7209 or 1234567 or (487) 555-7209 x", 1e-6), ("1234567 a 7654321 b 1234567 c 7654321", 0.05)):
        g = m.Graph(text, m.base_spans(text))
        node, chain, skip = rng.normal(0, 0.5, (5, m.FEATURES)), rng.normal(0, 0.5, (5, 5)), 0.8 * np.eye(5)
        field = m.Field(node, chain, skip)
        assert np.abs(field.marginals(g, rounds=200) - _enumerated(field, g)).max() < near, text
