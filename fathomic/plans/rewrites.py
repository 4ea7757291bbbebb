"""Rewrites that the optimizer doesn't make by itself.

Many sums of one column plus constants are one sum and one count; group keys that are a key
plus a constant depend on that key and need not be hashed. Both hold for whole numbers
only. Sums are widened to decimals, so a fused sum overflows no earlier than the plain one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomic.errors import Blocked


#: Keys of one top that may be sent to all executors.
MOST_SENT = 100_000


def _whole(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise Blocked("FX-TYPE", f"{column} is not a column of whole numbers")


def sums_with_offsets(df: DataFrame, column: str, offsets: Sequence[int], names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``SUM(column + k)`` for many k from one sum and one count."""
    _whole(df, column)
    names = names or [f"{column}_plus_{k}" for k in offsets]
    one = df.groupBy(*by).agg(F.sum(F.col(column).cast("decimal(20,0)")).alias("__s"), F.count(column).alias("__n"))
    return one.select(*by, *[(F.col("__s") + F.lit(k) * F.col("__n").cast("decimal(20,0)")).cast("bigint").alias(n) for k, n in zip(offsets, names, strict=True)])


def group_with_offsets(df: DataFrame, key: str, offsets: Mapping[str, int], measures: Sequence[Column], more: Sequence[str] = ()) -> DataFrame:
    """Grouping by ``key`` and ``key + k`` for each named k: hashed by ``key`` alone, the rest computed after."""
    _whole(df, key)
    out = df.groupBy(key, *more).agg(*measures)
    fixed = {n: F.col(key) + F.lit(k) for n, k in offsets.items()}
    kept = [c for c in out.columns if c not in (key, *more)]
    return out.withColumns(fixed).select(key, *offsets, *more, *kept)


def late_top(df: DataFrame, by: Sequence[str], n: int, key: str, ascending: bool = True, offset: int = 0) -> DataFrame:
    """The top rows found on narrow columns first; wide ones are fetched for those rows alone.

    Worth it where rows are wide and ``key`` is unique. Up to ``MOST_SENT`` keys are broadcast; more are shuffled.
    """
    order = [F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last() for c in by]
    chosen = df.select(key, *[c for c in by if c != key]).orderBy(*order)
    chosen = (chosen.offset(offset) if offset else chosen).limit(n).select(key)
    return df.join(F.broadcast(chosen) if n <= MOST_SENT else chosen.hint("merge"), key, "left_semi").orderBy(*order)
