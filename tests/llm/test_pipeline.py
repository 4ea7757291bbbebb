"""The pipeline's stages against plain code."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as cp
from fathomic.llm import pieces
from tests.llm.test_filters import tiles_by_search
from tests.llm.test_partenum import brute as components
from tests.llm.test_weakpii import brute as spans


def plain_words(text):
    cut = "".join(chr(c) for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", cut)
    return text.translate(table).split()


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    at = docs
    kept = {}
    for name, stage in cp.STAGES:
        path = str(tmp_path / name)
        stage(spark, at, sf).write.parquet(path)
        at = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r.asDict() for r in at.collect()}
        if name != "encode":
            assert at.columns == columns
    assert len(kept["language"]) == docs.count()
    rows = [(d, r["text"]) for d, r in kept["language"].items()]
    assert set(kept["near_duplicates"]) == {c for _, _, c in components(rows, 5, 80, 100)}
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seeds = [{tuple(q[i : i + 5]) for i in range(len(q) - 4)} for q in items]
    clean = set()
    for d, r in kept["near_duplicates"].items():
        w = plain_words(r["text"])
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if not any(s & own and tiles_by_search(q, w, 5) >= 0.8 * len(q) for q, s in zip(items, seeds, strict=True)):
            clean.add(d)
    assert set(kept["decontaminate"]) == clean
    for d, r in kept["personal_data"].items():
        assert not spans(r["text"])
        assert r["n_chars"] == len(r["text"])
        before = kept["decontaminate"][d]["text"]
        assert spans(before) or r["text"] == before or "[CARD]" in r["text"]
    p = pieces.Pieces(pieces._read(pieces.MODEL_PATH))
    for d, r in kept["encode"].items():
        assert r["round_trip"]
        assert p.decode(r["ids"]) == kept["personal_data"][d]["text"]


def test_run_gives_the_last_stage(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 0
    assert "ids" in out.columns


def test_awkward_tables(spark, awkward, empty, docs, tmp_path):
    """Nulls, repeated rows and ids, and clashing columns go through every stage; an empty table gives none."""
    import corpus_pipeline

    spark.createDataFrame([(1, "some benchmark text of a few words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = {c: F.lit("clash") for c in ("lang_pred", "rejected", "comp", "mark", "star", "__mark", "__place", "ids", "tokens")}
    labelled = docs.select("doc_id", "text", "lang").withColumns({c: F.lit("clash") for c in awkward.columns if c not in ("doc_id", "text", "lang")})
    for df in (awkward.unionByName(labelled).withColumns(more), empty.withColumns(more)):
        rows = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            if name != "encode":
                assert out.columns == rows.columns
            rows = out.cache()
        if df.isEmpty():
            assert rows.count() == 0
        else:
            kept = [r["doc_id"] for r in rows.select("doc_id").collect()]
            assert len(kept) > 0
