from __future__ import annotations

import hashlib
import math
import os

import pytest

from fathomic.llm import pieces as pc

pytestmark = pytest.mark.skipif(not os.path.exists(pc.MODEL_PATH), reason="no public vocabulary")


@pytest.fixture(scope="module")
def model():
    return pc._read(pc.MODEL_PATH)


def brute(p, text):
    """Best score of a text by trying every piece at every place."""
    s = (" " + text).replace(pc.MARK, "\0").replace(" ", pc.MARK)
    best = [0.0] + [-1e300] * len(s)
    known = {s[i:j]: p.automaton.get(s[i:j], None) for i in range(len(s)) for j in range(i + 1, min(len(s), i + 20) + 1)}
    for i in range(len(s)):
        if s[i] not in p.singles:
            best[i + 1] = max(best[i + 1], best[i] + p.unknown)
        for j in range(i + 1, min(len(s), i + 20) + 1):
            hit = known[s[i:j]]
            if hit:
                best[j] = max(best[j], best[i] + hit[1])
    return best[-1]


def score(p, text, ids):
    """Score of a path: pieces by their own scores, runs of byte pieces by their characters."""
    total, raw = 0.0, b""
    scores = {v[2]: v[1] for v in p.automaton.values()}
    for i in [*ids, -1]:
        if i >= 0 and i not in scores:
            raw += p.raw[i]
            continue
        total += p.unknown * len(raw.decode())
        raw = b""
        total += scores.get(i, 0.0)
    return total


def test_paths_are_optimal_and_decode(model, docs):
    p = pc.Pieces(model)
    texts = [r["text"][:300] for r in docs.limit(25).collect()] + ["a  b   c", "tab\tnew\n\nline", "日本 語", "▁x ▁"]
    for t in texts:
        ids = p.encode(t)
        assert p.decode(ids) == t
        assert score(p, t, ids.tolist()) == pytest.approx(brute(p, t), abs=1e-6)


def test_equals_the_library_on_a_unigram_model(model, docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    proto.normalizer_spec.remove_extra_whitespaces = False
    for x in proto.pieces:
        if x.type == 1:
            x.score = -math.log(2 - x.score)
    raw = proto.SerializeToString()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=raw), pc.Pieces(raw)
    texts = [r["text"] for r in docs.limit(60).collect()]
    same = 0
    for t in texts:
        want, got = library.encode(t), own.encode(t).tolist()
        same += want == got
        # the library adds in single precision, so equal sums may fall either way
        assert sum(map(library.get_score, want)) == pytest.approx(sum(map(library.get_score, got)), rel=1e-4)
    assert same > 0.8 * len(texts)


@pytest.mark.parametrize("rule", ["charsmap", "spaces", "prefix"])
def test_models_that_normalize_are_refused(model, rule):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    if rule == "charsmap":
        proto.normalizer_spec.precompiled_charsmap = b"x"
    elif rule == "spaces":
        proto.normalizer_spec.remove_extra_whitespaces = True
    else:
        proto.normalizer_spec.add_dummy_prefix = False
    with pytest.raises(ValueError, match="normalizes"):
        pc.Pieces(proto.SerializeToString())


def test_operator(docs, awkward, empty):
    out = pc.round_trip(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)
    odd = pc.round_trip(awkward).collect()
    assert len(odd) == awkward.count()
    assert all(r["round_trip"] for r in odd)
    assert pc.round_trip(empty).collect() == []
    back = {(r["doc_id"], r["text"]) for r in pc.decode(pc.encode(awkward)).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in awkward.collect()}
