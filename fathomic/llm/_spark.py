"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import gc
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomic.durable import durable

__all__ = ["bucket_of", "durable", "partitions", "parts_for", "range_bounds", "release", "with_edges"]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts_for(spark: SparkSession, nbytes: int, each: int = 32 << 20) -> int:
    """As many parts as hold ``each`` bytes, but no fewer than the session's partitions nor more than 2**17."""
    return max(partitions(spark), min(1 << 17, -(-nbytes // each)))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def range_bounds(df: DataFrame, key: str, count: int) -> list:
    """At most ``count - 1`` ascending distinct bounds that cut ``key`` into runs of near equal rows."""
    if count < 2:
        return []
    shares = [k / count for k in range(1, count)]
    found = df.select(F.percentile_approx(key, shares, max(1000, 4 * count)).alias("q")).first()["q"]
    return sorted(set(found or []))


def bucket_of(key: F.Column, bounds: list, kind: str) -> F.Column:
    """The number of sorted bounds at or below the key; null keys come first.

    Two steps, over every k-th bound and then within one run of k, so a row costs
    about the square root of the number of bounds.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    every = F.lit(bounds).cast(f"array<{kind}>")
    coarse = F.lit(bounds[::step]).cast(f"array<{kind}>")
    runs = F.array_size(F.filter(coarse, lambda b: b <= key))
    fine = F.slice(every, F.greatest(runs - 1, F.lit(0)) * step + 1, F.lit(step))
    at = F.greatest(runs - 1, F.lit(0)) * step + F.array_size(F.filter(fine, lambda b: b <= key))
    return F.coalesce(at, F.lit(0)).cast("int")


def with_edges(rows: DataFrame, bucket: str, order: list[str], wrap: bool = False, previous: bool = False) -> DataFrame:
    """``rows`` with column ``_edge`` 0, and copies of the rows just outside each bucket.

    A bucket gets the next bucket's first row with ``_edge`` 1 and, if asked for, the
    one before's last row with ``_edge`` -1, so its rows can be read in order with
    sight of both neighbours. Only keys, one or two for each bucket, are gathered.
    ``wrap``: the first row of all follows the last.
    """
    key = F.struct(*order)
    ends = {r["b"]: (r["lo"], r["hi"]) for r in rows.groupBy(F.col(bucket).alias("b")).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
    present = sorted(ends)
    wanted = []
    for i, b in enumerate(present):
        if wrap or i + 1 < len(present):
            nxt = present[(i + 1) % len(present)]
            wanted.append((nxt, b, 1, ends[nxt][0]))
        if previous and i:
            wanted.append((present[i - 1], b, -1, ends[present[i - 1]][1]))
    own = rows.withColumn("_edge", F.lit(0))
    if not wanted:
        return own
    kind = rows.select(key.alias("k")).schema["k"].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(wanted, f"hb int, nb int, side int, k {kind}")
    cond = F.col(bucket) == F.col("hb")
    for c in order:
        cond = cond & F.col(c).eqNullSafe(F.col(f"k.{c}"))
    # at most two keys a bucket, so its size is bounded by the bucket count
    copies = rows.join(F.broadcast(table), cond).select(*[F.col("nb").alias(c) if c == bucket else F.col(c) for c in rows.columns], F.col("side").alias("_edge"))
    return own.unionByName(copies)
