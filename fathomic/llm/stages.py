"""From raw documents to token ids in five stages.

Each stage is written as Parquet and read again, so a lost executor costs one stage's
tasks at most. All stages but the last return the columns of ``documents``, whatever their
names; a stage reads ``doc_id``, ``text``, ``lang`` and, where there is one, ``n_chars``.

Defined results: texts that are null, empty or without a letter are rejected by the first
stage; rows with null or repeated ids are rows of their own; equal rows are near copies,
so one of them stays; where no row has a language, none is learned and all are rejected;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fathomic.durable import shared_folder
from fathomic.llm import langid, partenum, pieces, tiling, weakpii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects: texts without a letter, or of no learned language."""
    return langid.keep_known(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one of the least id."""
    return partenum.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    return weakpii.redact(docs, weakpii.learn(docs), n_chars="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to."""
    return pieces.round_trip(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("encode", encode),
]

#: No stage but the filters is expressible in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table in the shared folder goes once the next is written."""
    place = f"{shared_folder(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
