import zlib
from collections import Counter

from gridloom.llm import op09_label_shards as m


def check(rows, docs, shards):
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    per = Counter(r["shard"] for r in rows)
    counts = [per.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert {r["law"] for r in rows} <= {"rows"} and {r["grown_shard"] for r in rows} <= {None}


def cut(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r["size"], r["text_crc32"]), Counter())[r["shard"]] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values())


def test_groups_come_together(spark, documents):
    docs = [r.asDict() for r in documents.collect()]
    for shards in (3, 16):
        rows = m.label_shards(documents, shards).collect()
        check(rows, docs, shards)
        assert cut(rows) == 0 and sum(r["linked"] for r in rows) > 0


def test_group_larger_than_a_shard(spark):
    docs = [{"doc_id": i, "text": "same text" if i % 3 == 0 else f"text {i // 2 if i % 2 else i}"} for i in range(900)]
    rows = m.label_shards(spark.createDataFrame(docs, "doc_id bigint, text string"), 8).collect()
    check(rows, docs, 8)
    hot = Counter(r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(b"same text"))
    assert max(hot.values()) >= 100 and len(hot) <= 5


def test_odd_rows(odd, empty):
    check(m.label_shards(odd, 4).collect(), [r.asDict() for r in odd.collect()], 4)
    assert m.label_shards(empty).count() == 0


def test_small_groups_unite_beside_a_group_larger_than_a_shard(spark):
    docs = [{"doc_id": i, "text": "same text" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"text {i}"} for i in range(3000)]
    rows = m.label_shards(spark.createDataFrame(docs, "doc_id bigint, text string"), 16).collect()
    check(rows, docs, 16)
    hot = zlib.crc32(b"same text")
    assert cut([r for r in rows if r["text_crc32"] != hot]) == 0
    assert len({r["shard"] for r in rows if r["text_crc32"] == hot}) <= 9
