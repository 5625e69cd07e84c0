import hashlib
import re

from gridloom.llm import op10_block_naming as m


def brute(docs):
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d["text"] or ""), []).append(i)
    out = []
    for norm, g in groups.items():
        best = min(g, key=lambda i: (-len(docs[i]["text"] or ""), docs[i]["doc_id"] is None, docs[i]["doc_id"] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(docs[i]["doc_id"], docs[best]["doc_id"], len(g), i == best, sha) for i in g]
    return sorted(out, key=repr)


def compare(df, **kw):
    docs = [r.asDict() for r in df.collect()]
    rows = m.exact_duplicates(df, **kw).collect()
    assert [r[:5] for r in sorted(map(tuple, rows), key=repr)] == brute(docs)


def test_table(documents):
    compare(documents)
    compare(documents, block_bytes=16)


def test_blocks_that_differ_late_and_lengths_around_a_block(spark):
    texts = ["x" * n for n in (0, 1, 7, 8, 9, 15, 16, 17, 63, 64, 65)] + ["x" * 64 + " ", "y" + "x" * 63, "x" * 63 + "y", "x" * 8 + "y" * 8, "y" * 8 + "x" * 8, " x", "x "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id bigint, text string").repartition(5)
    compare(df, block_bytes=8)


def test_odd_rows(spark, odd, empty):
    compare(odd)
    assert m.exact_duplicates(empty).count() == 0
    out = m.stage(spark, odd, "")
    assert out.columns == odd.columns and out.count() == m.exact_duplicates(odd).filter("kept").count()


def test_hot_block_and_hot_null_id(spark):
    """A third of the rows share a block, another third are the same row without an id."""
    docs = [(i, "h" * 64 + f"{i:08d}") for i in range(700)] + [(None, "q" * 64 + "same")] * 700 + [(i, f"{i:072d}") for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    compare(df, block_bytes=64)
    out = m.stage(spark, df, "")
    assert out.count() == 1401 and out.filter("doc_id is null").count() == 1
