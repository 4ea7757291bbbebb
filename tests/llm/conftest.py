"""Fixtures of the training-data operators."""

from __future__ import annotations

import pytest

AWKWARD = [
    (1, "Alpha beta gamma delta.\nSecond line here.", "en"),
    (2, "", "en"),
    (3, None, None),
    (4, " \n\t ", "fr"),
    (5, "x" * 50_000 + " " + "word " * 5_000, "en"),
    (5, "same id other text", "en"),
    (6, "Alpha beta gamma delta.\nSecond line here.", "en"),
    (6, "Alpha beta gamma delta.\nSecond line here.", "en"),
    (None, "no id at all", None),
    (7, "日本語のテキスト 🎉 \u2581 \x00 é", "ja"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    clash = {c: F.lit("clash") for c in ("id", "shard", "bucket", "node", "unit", "words", "score", "held_out", "cell", "key", "part", "host", "kind")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
