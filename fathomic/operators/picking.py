"""Picking rows: head, tail, samples, largest and smallest with tie policies, top rows of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomic.errors import Blocked
from fathomic.operators.order import INDEX, with_row_index


def tail(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows in their order."""
    if n < 0:
        raise Blocked("FX-ARGUMENT", "a count is not negative")
    rows = df if order else with_row_index(df)
    by = order or [INDEX]
    return rows.orderBy(*[F.col(c).desc() for c in by]).limit(n).orderBy(*by).select(*df.columns)


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 0, weights: str | None = None, replace: bool = False, key: list[str] | None = None) -> DataFrame:
    """A seeded sample of ``n`` rows or a share of them.

    Each row's place is a hash of the seed and its key (or row index), so the same rows
    are drawn however they are partitioned. Weighted draws take the largest
    ``ln(u) / w``. With replacement, each draw falls on a row by its share, or by its weight.
    """
    if (n is None) == (fraction is None):
        raise Blocked("FX-ARGUMENT", "give a count or a fraction")
    if (n or 0) < 0 or (fraction or 0) < 0 or (not replace and (fraction or 0) > 1):
        raise Blocked("FX-ARGUMENT", "a sample's size is out of range")
    rows = df if key else with_row_index(df)
    by = key or [INDEX]
    unit = (F.pmod(F.xxhash64(F.lit(seed), *by), F.lit((1 << 52) - 1)) + 1).cast("double") / float(1 << 52)
    if replace:
        numbered = with_row_index(df)
        total = numbered.count()
        draws = n if n is not None else round(fraction * total)
        if not total or not draws:
            return df.limit(0)
        if weights:
            return _weighted_draws(numbered, total, draws, seed, weights).select(*df.columns)
        picks = df.sparkSession.range(draws).select(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias(INDEX))
        return numbered.join(picks.groupBy(INDEX).count(), INDEX).withColumn("__d", F.explode(F.sequence(F.lit(1), F.col("count").cast("int")))).select(*df.columns)
    if weights:
        bad = F.col(weights) < 0
        rank = F.when(bad, F.raise_error(F.lit("sample: a weight is negative"))).when(F.col(weights) > 0, F.log(unit) / F.col(weights))
        rows, order = rows.withColumn("__rank", rank).filter("__rank IS NOT NULL"), F.col("__rank").desc()
    else:
        rows, order = rows.withColumn("__rank", unit), F.col("__rank").asc()
        if fraction is not None and n is None:
            return rows.filter(F.col("__rank") <= fraction).select(*df.columns)
    count = n if n is not None else round(fraction * rows.count())
    return rows.orderBy(order, *by).limit(count).select(*df.columns)


def _weighted_draws(rows: DataFrame, total: int, draws: int, seed: int, weights: str) -> DataFrame:
    """Draws with replacement: each falls on the row whose stretch of the summed weights holds it.

    Rows are summed in at most 1,024 blocks, whose totals alone reach the driver; within a
    block, rows and draws are walked in one order of place.
    """
    weight = F.when(F.col(weights) < 0, F.raise_error(F.lit("sample: a weight is negative"))).otherwise(F.coalesce(F.col(weights).cast("double"), F.lit(0.0)))
    block = F.floor(F.col(INDEX) / max(1 << 16, -(-total // 1024))).cast("int")
    rows = rows.withColumn("__w", weight).withColumn("__b", block)
    begins, at = {}, 0.0
    for r in sorted(rows.groupBy("__b").agg(F.sum("__w").alias("s")).collect(), key=lambda r: r["__b"]):
        begins[r["__b"]] = at
        at += r["s"]
    if not at:
        return rows.limit(0)
    starts = F.lit(list(begins.values())).cast("array<double>")
    own = F.sum("__w").over(W.partitionBy("__b").orderBy(INDEX).rowsBetween(W.unboundedPreceding, -1))
    stretches = rows.select("__b", (F.element_at(starts, F.col("__b") + 1) + F.coalesce(own, F.lit(0.0))).alias("__p"), F.col(INDEX).alias("__i"))
    place = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(1 << 52)).cast("double") / float(1 << 52) * at
    picks = rows.sparkSession.range(draws).select(place.alias("__p")).select((F.array_size(F.filter(starts, lambda s: s <= F.col("__p"))) - 1).alias("__b"), "__p", F.lit(None).cast("long").alias("__i"))
    walk = W.partitionBy("__b").orderBy("__p", F.col("__i").asc_nulls_last())
    hit = stretches.unionByName(picks).withColumn("__h", F.last("__i", ignorenulls=True).over(walk)).filter("__i IS NULL").groupBy(F.col("__h").alias(INDEX)).count()
    return rows.join(hit, INDEX).withColumn("__d", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))


def n_extreme(df: DataFrame, n: int, columns: list[str], largest: bool = True, keep: str = "first", order: list[str] | None = None) -> DataFrame:
    """The rows of the ``n`` greatest or least values; ties by ``keep``: first, last or all. Nulls don't count."""
    if keep not in ("first", "last", "all"):
        raise Blocked("FX-ARGUMENT", "keep is first, last or all")
    rows = df.dropna(subset=columns)
    sort = [F.col(c).desc() if largest else F.col(c).asc() for c in columns]
    if keep == "all":
        # the n-th row's values, then every row at least as extreme: no global window
        edge = rows.orderBy(*sort).limit(n).select(*columns).orderBy(*[F.col(c).asc() if largest else F.col(c).desc() for c in columns]).limit(1).collect()
        if not edge:
            return df.limit(0)
        within = F.lit(False)
        equal = F.lit(True)
        for c in columns:
            v = F.lit(edge[0][c])
            within = within | (equal & (F.col(c) > v if largest else F.col(c) < v))
            equal = equal & (F.col(c) == v)
        return rows.filter(within | equal).orderBy(*sort).select(*df.columns)
    if not order:
        rows, order = with_row_index(rows), [INDEX]
    ties = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return rows.orderBy(*sort, *ties).limit(n).select(*df.columns)


def top_per_group(df: DataFrame, by: list[str], n: int, order: list) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups to ``n`` before it shuffles them."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")
