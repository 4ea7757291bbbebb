"""Approximate distinct counts by mergeable HyperLogLog sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def approx_count_distinct(df: DataFrame, column: str, by: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.approx_count_distinct(column, rsd).alias("approx_distinct"))


def beside_exact(df: DataFrame, column: str, rsd: float = 0.02) -> DataFrame:
    """The approximate and the exact count, counted apart: one aggregation of both would keep a sketch for each distinct value."""
    return approx_count_distinct(df, column, rsd=rsd).crossJoin(df.agg(F.count_distinct(column).alias("distinct")))


def build(df: DataFrame, column: str, by: list[str] | None = None, lg_k: int = 14) -> DataFrame:
    """A sketch for each group, as binary that can be stored."""
    return df.groupBy(*(by or [])).agg(F.hll_sketch_agg(column, lg_k).alias("sketch"))


def merge(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts become those of the whole."""
    return sketches.groupBy(*(by or [])).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("approx_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
