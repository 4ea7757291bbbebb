"""Source order: a row index, and numbers in the order of columns, without one task for all rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomic.durable import durable

INDEX = "__row"

# Plans of these nodes deal rows out anew, perhaps otherwise at each run.
_MOVES = re.compile(r"\b(Sort|Join|Aggregate|Repartition\w*|Window|Limit|Distinct|Deduplicate|Sample|Rebalance\w*)\b")


def with_row_index(df: DataFrame, name: str = INDEX, start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in the frame's own order.

    ``monotonically_increasing_id`` holds the partition in its upper bits; the counts of
    the partitions, one number each, are all that is gathered. A scan gives the same
    partitions each time; any other plan is written down first.
    """
    raw = df.withColumn("__m", F.monotonically_increasing_id())
    if _MOVES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        raw = durable(raw)
    part = F.shiftright("__m", 33)
    counts = {r["p"]: r["n"] for r in raw.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    return _numbered(raw, counts, part, F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)), name, start).drop("__m")


def numbered(df: DataFrame, order: list[str], name: str = INDEX, start: int = 0, runs: int | None = None, ascending: list[bool] | None = None) -> DataFrame:
    """Dense numbers from ``start`` in the order of columns; nulls count as least.

    Rows are cut into runs at fixed bounds of the first column; each run is numbered by
    itself from where the one before ends. Equal rows are numbered in either order.
    """
    up = ascending or [True] * len(order)
    runs = runs or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(df, order[0], runs)
    run = F.lit(0)
    if bounds:
        kind = df.schema[order[0]].dataType
        at = F.array(*[F.lit(b).cast(kind) for b in bounds])
        run = F.coalesce(F.array_size(F.filter(at, lambda b: b <= F.col(order[0]))), F.lit(0))
        run = run if up[0] else F.lit(len(bounds)) - run
    rows = df.withColumn("__run", run.cast("int"))
    counts = {r["p"]: r["n"] for r in rows.groupBy(F.col("__run").alias("p")).agg(F.count("*").alias("n")).collect()}
    sort = [F.col(c).asc_nulls_first() if u else F.col(c).desc_nulls_last() for c, u in zip(order, up, strict=True)]
    place = F.row_number().over(W.partitionBy("__run").orderBy(*sort)) - 1
    return _numbered(rows, counts, F.col("__run"), place, name, start).drop("__run")


def ranked(df: DataFrame, kind: str, order: list[str], name: str, ascending: list[bool] | None = None) -> DataFrame:
    """``row_number``, ``rank`` or ``dense_rank`` of the whole table, without a task that reads all of it."""
    if kind == "row_number":
        return numbered(df, order, name, 1, ascending=ascending)
    if kind == "dense_rank":
        keys = numbered(df.select(*order).distinct(), order, name, 1, ascending=ascending)
    else:
        keys = numbered(df.select(*order), order, name, 1, ascending=ascending).groupBy(*order).agg(F.min(name).alias(name))
    keys = keys.withColumnsRenamed({c: f"__key_{k}" for k, c in enumerate(order)})
    same = [F.col(c).eqNullSafe(F.col(f"__key_{k}")) for k, c in enumerate(order)]
    return df.join(keys, same).drop(*[f"__key_{k}" for k in range(len(order))])


def _numbered(rows: DataFrame, counts: dict[int, int], part: F.Column, place: F.Column, name: str, start: int) -> DataFrame:
    starts, at = {}, start
    for p in sorted(counts):
        starts[p] = at
        at += counts[p]
    if not starts:
        return rows.withColumn(name, F.lit(start).cast("long"))
    table = F.lit([starts.get(p, 0) for p in range(max(starts) + 1)]).cast("array<bigint>")
    return rows.withColumn(name, F.element_at(table, part.cast("int") + 1) + place.cast("bigint"))


def _bounds(df: DataFrame, column: str, runs: int) -> list:
    """Distinct ascending values that cut a column into about ``runs`` parts of near equal rows."""
    kind = df.schema[column].dataType
    if runs < 2:
        return []
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        found = df.select(F.percentile_approx(column, [k / runs for k in range(1, runs)], max(1000, 4 * runs)).alias("q")).first()["q"]
        return sorted(set(found or []))
    if isinstance(kind, T.StringType):
        # a hashed sample sets where runs are cut; the order doesn't depend on it
        total = df.count()
        share = min(1.0, 64 * runs / max(1, total))
        picked = df.filter(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).select(column)
        found = sorted({r[0] for r in picked.distinct().limit(64 * runs).collect()}, key=lambda s: s.encode())
        return sorted({found[k * len(found) // runs] for k in range(1, runs)}, key=lambda s: s.encode()) if found else []
    return []
