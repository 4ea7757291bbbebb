"""The ten operators as queries over a folder of tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomic.llm import bloom_cascade, ctw, fingerprint, langid, pagediff, partenum, pieces, ring, stages, tiling, weakpii


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ctw.score(docs, langid.held_out("doc_id", 1))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join(_table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(_table(spark, sf_dir, "documents"), 8)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return weakpii.find(docs, weakpii.learn(docs))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_cascade.judge(_table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(~langid.held_out("doc_id")))
    rows = docs.select("doc_id", langid.held_out("doc_id").alias("held_out"), "text")
    return langid.predict(rows, model, ["doc_id", "held_out"])


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(_table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprint": op1_fingerprint,
        "op2_lm_score": op2_lm_score,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_shards": op5_shards,
        "op6_pii": op6_pii,
        "op7_url_filter": op7_url_filter,
        "op8_language": op8_language,
        "op9_main_text": op9_main_text,
        "op10_decontaminate": op10_decontaminate,
        "pipeline": stages.run,
    }


# The rules and the hosts of bloom_cascade, judged by comparison.
OP7_SQL = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN ''
              ELSE substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
  FROM parts JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT parts.page_id, host, path, fits.rule,
       coalesce(fits.verdict,
                CASE WHEN regexp_matches(host, '(^|\.)(ads-track|casino-win|cheap-pills|free-bets)\.example\.com$')
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL}
