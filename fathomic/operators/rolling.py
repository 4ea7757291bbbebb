"""Rolling windows and forward fills in source order.

With partition columns they are plain window functions. Without, one window would put all
rows in one task; there the rows are cut into ranges of the order, and each range
also gets the rows just outside it that its frames reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomic.errors import Blocked
from fathomic.operators.order import INDEX, numbered, with_row_index

FUNCTIONS = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}


def frame_bounds(window: int, center: bool) -> tuple[int, int]:
    """Rows before and after the current one."""
    if window < 1:
        raise Blocked("FX-ARGUMENT", "a window has at least one row")
    after = (window - 1) // 2 if center else 0
    return window - 1 - after, after


def _value(column: str, fn: str, minimum: int, spec: W) -> Column:
    if fn not in FUNCTIONS:
        raise Blocked("FX-ARGUMENT", f"no rolling function {fn}")
    seen = F.count(column).over(spec)
    return F.when(seen >= minimum, FUNCTIONS[fn](column).over(spec))


def rolling(df: DataFrame, column: str, fn: str, window: int, min_periods: int | None = None, center: bool = False, by: list[str] | None = None, order: list[str] | None = None, name: str | None = None) -> DataFrame:
    """``df`` with the function of the last ``window`` rows; null below ``min_periods`` non-null values."""
    before, after = frame_bounds(window, center)
    minimum = window if min_periods is None else min_periods
    if not 0 <= minimum <= window:
        raise Blocked("FX-ARGUMENT", "min_periods is not within the window")
    name = name or f"{column}_{fn}"
    if by:
        if not order:
            raise Blocked("FX-ARGUMENT", "partitions need order columns")
        spec = W.partitionBy(*by).orderBy(*order).rowsBetween(-before, after)
        return df.withColumn(name, _value(column, fn, minimum, spec))
    return ranged(df, order, before, after, lambda spec: {name: _value(column, fn, minimum, spec.rowsBetween(-before, after))})


def ranged(df: DataFrame, order: list[str] | None, before: int, after: int, columns) -> DataFrame:
    """Window columns over the whole table, in blocks of consecutive rows.

    Rows are numbered in order first; block ``k`` then also gets the ``before`` last
    rows of earlier blocks and the ``after`` first of later ones, as copies.
    """
    columns_in = df.columns
    rows = numbered(df, order) if order else with_row_index(df)
    size = max(4096, 4 * (before + after))
    block = F.floor(F.col(INDEX) / size).cast("long")
    first, last = F.floor(F.greatest(F.col(INDEX) - after, F.lit(0)) / size).cast("long"), F.floor((F.col(INDEX) + before) / size).cast("long")
    spread = rows.withColumn("__home", block).withColumn("__block", F.explode(F.sequence(first, last)))
    spec = W.partitionBy("__block").orderBy(INDEX)
    out = spread.withColumns(columns(spec)).filter("__block = __home")
    return out.select(*columns_in, *[c for c in out.columns if c not in (*columns_in, INDEX, "__home", "__block")])


def ffill(df: DataFrame, column: str, limit: int | None = None, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Nulls of ``column`` take the last value before them, at most ``limit`` rows back."""
    if limit is not None and limit < 1:
        raise Blocked("FX-ARGUMENT", "a limit is at least one row")
    back = W.unboundedPreceding if limit is None else -limit
    if by:
        if not order:
            raise Blocked("FX-ARGUMENT", "partitions need order columns")
        return df.withColumn(column, F.last(column, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(back, 0)))
    names = df.columns
    if limit is not None:
        out = ranged(df, order, limit, 0, lambda spec: {"__filled": F.last(column, ignorenulls=True).over(spec.rowsBetween(-limit, 0))})
        return out.withColumn(column, F.col("__filled")).select(*names)
    # without a limit: fill within blocks, then take the last value of the blocks before
    rows = numbered(df, order) if order else with_row_index(df)
    rows = rows.withColumn("__block", F.floor(F.col(INDEX) / 65_536).cast("long"))
    ends = rows.filter(F.col(column).isNotNull()).groupBy("__block").agg(F.max_by(column, INDEX).alias("__end"))
    every = rows.select("__block").distinct().join(ends, "__block", "left")
    # a row for each block of 65,536 rows
    carried = every.withColumn("__carry", F.last("__end", ignorenulls=True).over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))).select("__block", "__carry")
    inside = F.last(column, ignorenulls=True).over(W.partitionBy("__block").orderBy(INDEX).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__filled", inside).join(carried, "__block", "left").withColumn(column, F.coalesce("__filled", "__carry")).select(*names)
