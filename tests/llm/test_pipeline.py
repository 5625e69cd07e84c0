import re
import zlib

import corpus_pipeline
import __spark_entry__ as entry
from gridloom.llm import op01_sentencepiece as sp
from gridloom.llm import op04_toxicity_cnn as cnn
from gridloom.llm import op05_cube_mix as mix
from gridloom.llm.common import store
from test_op06_chosen_path import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents):
    docs, steps = documents, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()] if k else [r.asDict() for r in documents.collect()]
        out = store(stage(spark, docs, SF), name)
        if k < 4:
            assert out.columns == documents.columns
        after = [r.asDict() for r in out.collect()]
        steps.append(name)
        if name == "toxicity":
            c = cnn.learn(documents, spark.read.parquet(f"{SF}/labels.parquet"))
            want = [d["doc_id"] for d in before if c.score([cnn.word_ids(d["text"] or "")])[0] < c.thresholds.get(d["lang"], c.thresholds[None])]
            assert sorted(d["doc_id"] for d in after) == sorted(want) and 0 < len(want) <= len(before)
        elif name == "exact_dedup":
            groups = {}
            for d in before:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", d["text"] or ""), []).append(d)
            want = [max(g, key=lambda d: (len(d["text"] or ""), -d["doc_id"]))["doc_id"] for g in groups.values()]
            assert sorted(d["doc_id"] for d in after) == sorted(want)
        elif name == "near_dedup":
            assert sorted(d["doc_id"] for d in after) == sorted({c for _, c, _, _ in brute(before)})
        elif name == "mix":
            copies = {r["doc_id"]: r["copies"] for r in mix.mix(docs).collect()}
            assert sorted(d["doc_id"] for d in after) == sorted(i for i, n in copies.items() for _ in range(n))
        else:
            pm = sp.model(sp._path())
            text = {d["doc_id"]: d["text"] for d in before}
            assert len(after) == len(before) and all(r["ids"] == pm.encode(text[r["doc_id"]]).tolist() and r["round_trip"] for r in after)
        docs = out
    assert steps == ["toxicity", "exact_dedup", "near_dedup", "mix", "encode"]
    assert zlib.crc32(b"") == 0 and corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, SF), "odd")
            docs.count()


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
