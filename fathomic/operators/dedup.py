"""Duplicates by a subset of columns: keep the first, the last or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomic.errors import Blocked
from fathomic.operators.order import INDEX, with_row_index


def _keys(df: DataFrame, subset: list[str] | None) -> list[str]:
    keys = list(subset or df.columns)
    missing = [c for c in keys if c not in df.columns]
    if missing:
        raise Blocked("FX-COLUMN", f"no column {', '.join(missing)}")
    return keys


def _ordered(df: DataFrame, order: list[str] | None) -> tuple[DataFrame, list[str], list[str]]:
    return (df, list(order), []) if order else (with_row_index(df), [INDEX], [INDEX])


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None) -> DataFrame:
    """One row of each group of equal keys (nulls are equal), or with ``keep=False`` only keys met once.

    The first and last are found by aggregation, so a hot key is reduced before it moves.
    """
    if keep not in ("first", "last", False):
        raise Blocked("FX-ARGUMENT", "keep is first, last or False")
    keys = _keys(df, subset)
    if keep is not False and not order and set(keys) == set(df.columns):
        return df.distinct()
    rows, by, extra = _ordered(df, order)
    rest = [c for c in rows.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("__one"))
    key = F.struct(*by)
    pick = F.max_by(whole, key) if keep == "last" else F.min_by(whole, key)
    groups = rows.groupBy(*keys).agg(pick.alias("__row_of"), F.count("*").alias("__n"))
    if keep is False:
        groups = groups.filter("__n = 1")
    out = groups.select(*keys, *[F.col(f"__row_of.{c}").alias(c) for c in rest])
    return out.select(*df.columns)


def duplicated(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None, name: str = "duplicated") -> DataFrame:
    """``df`` with a mask that is true for the rows ``drop_duplicates`` would drop.

    Which row of a group stays is an aggregate, met by the rows in a join: a hot key is
    reduced before it moves, and its rows may be split over tasks.
    """
    if keep not in ("first", "last", False):
        raise Blocked("FX-ARGUMENT", "keep is first, last or False")
    keys = _keys(df, subset)
    rows = with_row_index(df)
    place = F.struct(*(order or []), INDEX)
    kept = rows.groupBy(*keys).agg((F.max if keep == "last" else F.min)(place).alias("__kept"), F.count("*").alias("__n"))
    kept = kept.withColumnsRenamed({c: f"__key_{k}" for k, c in enumerate(keys)})
    both = rows.join(kept, [F.col(c).eqNullSafe(F.col(f"__key_{k}")) for k, c in enumerate(keys)])
    return both.withColumn(name, F.col("__n") > 1 if keep is False else place != F.col("__kept")).select(*df.columns, name)
