"""Reshaping: melt, explode, pivot, pivot tables with margins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomic.errors import Blocked

AGGREGATES = {"sum": F.sum, "count": F.count, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max}


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """A row for each value column; columns of different types become text."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    if not values:
        raise Blocked("FX-ARGUMENT", "there is no value column")
    kinds = {df.schema[c].dataType for c in values}
    numeric = all(isinstance(k, T.NumericType) for k in kinds)
    if len(kinds) > 1 and not numeric:
        df = df.withColumns({c: F.col(c).cast("string") for c in values})
    return df.unpivot(ids, values, var_name, value_name)


def explode(df: DataFrame, columns: list[str], keep_empty: bool = True) -> DataFrame:
    """A row for each element; several lists go in step and must be of equal size.

    Null and empty lists give one row of null with ``keep_empty``, else none.
    """
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.ArrayType):
            raise Blocked("FX-TYPE", f"{c} is no list")
    make = F.explode_outer if keep_empty else F.explode
    if len(columns) == 1:
        c = columns[0]
        return df.withColumn(c, make(c))
    sizes = [F.coalesce(F.array_size(c), F.lit(0)) for c in columns]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.when(~same, F.raise_error(F.lit("explode: lists differ in size"))).otherwise(F.arrays_zip(*columns))
    out = df.withColumn("__zip", make(zipped))
    return out.withColumns({c: F.col(f"__zip.{c}") for c in columns}).drop("__zip")


def explode_fields(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Elements of a list of structs, with the chosen fields as ``column.field``."""
    out = explode(df, [column])
    return out.withColumns({f"{column}.{f}": F.col(f"`{column}`").getField(f) for f in fields}).drop(column)


def pivot(df: DataFrame, index: list[str], columns: str, values: str, names: list | None = None) -> DataFrame:
    """A column for each value of ``columns``; two rows for one cell are a conflict."""
    twice = F.count(F.lit(1)) > 1
    cell = F.when(twice, F.raise_error(F.lit("pivot: two rows claim one cell"))).otherwise(F.first(values))
    return df.groupBy(*index).pivot(columns, names).agg(cell)


#: Values that a pivoted table may read as its columns by itself.
MOST_NAMES = 10_000


def pivot_table(df: DataFrame, index: list[str], columns: str, values: str, agg: str = "mean", fill_value=None, dropna: bool = True, margins: bool = False, margins_name: str = "All", names: list | None = None) -> DataFrame:
    """Cells by an aggregate, with totals of rows and columns if asked for.

    ``names``: the values of ``columns``; without, they are read first.
    """
    if agg not in AGGREGATES:
        raise Blocked("FX-ARGUMENT", f"no aggregate {agg}")
    fn = AGGREGATES[agg]
    if names is None:
        found = df.filter(F.col(columns).isNotNull()).select(columns).distinct().limit(MOST_NAMES + 1).collect()
        if len(found) > MOST_NAMES:
            raise Blocked("FX-ARGUMENT", f"{columns} has more than {MOST_NAMES} values; give the names to pivot")
        names = sorted(r[0] for r in found)
    body = df.filter(F.col(columns).isNotNull())
    headers = [str(n) for n in names]
    if any(f.name in headers for f in df.schema if f.name in index):
        raise Blocked("FX-CONFLICT", "a pivoted name is that of an index column")

    def cells(rows: DataFrame, keys: list) -> DataFrame:
        # one aggregate for each name: a single shuffle, and totals in the same pass
        each = [fn(F.when(F.col(columns) == n, F.col(values))).alias(h) for n, h in zip(names, headers, strict=True)]
        total = [fn(F.when(F.col(columns).isin(names), F.col(values))).alias(margins_name)] if margins else []
        return rows.groupBy(*keys).agg(*each, *total)

    out = cells(body, index)
    if margins:
        last = cells(body, [])
        texts = {c: F.col(c).cast("string") for c in index}
        mark = {c: F.lit(margins_name if k == 0 else "") for k, c in enumerate(index)}
        out = out.withColumns(texts).unionByName(last.withColumns(mark).select(*out.columns))
    if agg == "count":
        # counts of no rows are not values
        out = out.withColumns({h: F.nullif(F.col(f"`{h}`"), F.lit(0).cast("long")) for h in headers})
    if dropna:
        some = F.coalesce(*[F.col(f"`{h}`").cast("string") for h in headers]) if headers else F.lit("")
        out = out.filter(some.isNotNull())
    return out.fillna(fill_value, subset=headers) if fill_value is not None else out
