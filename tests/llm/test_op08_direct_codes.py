import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import op08_direct_codes as m
from gridloom.session import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        out.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def key(t):
    return tuple((x is not None, x or 0) for x in t)


def test_whole_table(spark, documents):
    path = new_path(spark, "ids")
    m.write_ids(documents, path, PATH, segment_ids=3000)
    got = sorted(map(tuple, m.read_documents(spark, path).collect()), key=key)
    assert got == sorted(expected(documents.collect()), key=key)


def test_odd_rows(spark, odd, empty):
    unique = odd.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    path = new_path(spark, "ids")
    m.write_ids(unique, path, PATH)
    assert sorted(map(tuple, m.read_documents(spark, path).collect())) == sorted(expected(unique.collect()))
    path = new_path(spark, "ids")
    m.write_ids(odd, path, PATH)
    rows = sorted(m.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == odd.count() and [r["doc_id"] for r in rows][:2] == [None, None]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    path = new_path(spark, "ids")
    m.write_ids(empty, path, PATH)
    assert m.read_documents(spark, path).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    levels = m.pack(np.array(ids, np.uint32))
    assert m.unpack(levels).tolist() == ids
    for i in range(0, len(ids), 7):
        assert m.token_at(levels, i) == ids[i]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from("abe Z9 .,!'  \n\t\r\x0b\x1c\x85\xa0\u180e\u200b é漢ę🙂s-Ġ"), max_size=40))
def test_pieces_encode_like_the_whole(text):
    e = m.encoder(PATH)
    assert np.frombuffer(e([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_lines_in_one_batch():
    e = m.Encoder(PATH)
    texts = ["a\nb c.\nD", "x <|endoftext|>\ny", "a \nb", "a\n\nb", "a\n", "\na b", "a\tb\n\tc", "q\n b c.\nD", "a b.\n, c"]
    for _ in range(2):
        assert [np.frombuffer(c, "<u4").tolist() for c in e(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
