import functools
import math
import tempfile

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import op01_sentencepiece as m

PATH = public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def unigram_file():
    """The same pieces as a unigram model. Its runs of marks get ranks, since next to their stored
    -1e9 the library's 32-bit sums lose the other scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000)
    with tempfile.NamedTemporaryFile(suffix=".model", delete=False) as f:
        f.write(proto.SerializeToString())
    return f.name


@functools.cache
def library():
    return sentencepiece.SentencePieceProcessor(model_file=unigram_file())


def brute(pm, text):
    """Best score of any segmentation, by trying every piece at every position."""
    score = {pm.pieces[i]: s for i, s in pm.score.items()}
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 48), j):
            s = score.get(text[i:j], pm.unknown if j - i == 1 else -math.inf)
            best[j] = max(best[j], best[i] + s)
    return best[-1]


def path_score(pm, ids):
    total, run = 0.0, []
    for i in [*ids, None]:
        if i in pm.of_byte:
            run.append(pm.of_byte[i])
            continue
        total += pm.unknown * len(bytes(run).decode())
        run = []
        total += pm.score[i] if i is not None else 0.0
    return total


TEXTS = st.text(alphabet=st.sampled_from("theandrsing ouç漢🙂\n\t.,1  ▁\x00"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_best_score_and_round_trip(text):
    for scores in ("zipf", "model"):
        pm = m.model(PATH, scores)
        ids = pm.encode(text)
        assert pm.decode(ids) == text
        assert library().decode(ids.tolist()) == text
        if "▁" not in text and text:
            assert math.isclose(path_score(pm, ids.tolist()), brute(pm, (" " + text).replace(" ", "▁")), rel_tol=1e-9)


def test_same_ids_as_the_library(documents):
    pm = m.model(unigram_file(), "model")
    for r in documents.limit(30).collect():
        for line in [" ".join(r["text"].split(" ")[k : k + 9]) for k in range(0, 90, 9)]:
            # below 2**24 the library's 32-bit sums of ranks are exact
            assert pm.encode(line).tolist() == library().encode(line)


def test_tables(spark, documents, odd, empty):
    rows = m.encode(documents, PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    pm = m.model(PATH)
    assert len(rows) == len(texts) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert all(r["ids"] == pm.encode(texts[r["doc_id"]]).tolist() for r in rows)
    back = m.decode(m.encode(odd, PATH), PATH).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in back))) == sorted(map(str, ((r["doc_id"], r["text"] or "") for r in odd.collect())))
    assert m.encode(empty, PATH).count() == 0
    assert m.stage(spark, odd, "").count() == odd.count()
