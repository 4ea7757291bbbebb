"""Tables without a source: rows, ranges, calendars."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomic.errors import Blocked

_TYPES = {
    "bool": "boolean", "boolean": "boolean", "int64": "bigint", "int": "bigint", "float64": "double", "float": "double",
    "utf8": "string", "string": "string", "binary": "binary", "date32": "date", "date": "date", "timestamp_micros": "timestamp", "uint64": "decimal(20,0)",
}
INT64 = (-(1 << 63), (1 << 63) - 1)


def type_name(name: str) -> str:
    """The Spark type of a logical type's name."""
    name = name.strip().lower()
    if name.startswith("decimal128"):
        return name.replace("decimal128", "decimal")
    if name.startswith("decimal("):
        return name
    if name not in _TYPES:
        raise Blocked("FX-TYPE", f"no type named {name}")
    return _TYPES[name]


def from_rows(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    depth, parts, at = 0, [], 0
    for k, c in enumerate(schema):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(schema[at:k])
            at = k + 1
    parts.append(schema[at:])
    fields = [p.strip().partition(":") for p in parts]
    names = [n.strip() for n, _, _ in fields]
    if len(set(names)) != len(names):
        raise Blocked("FX-CONFLICT", "a column is named twice")
    rows = [tuple(r) for r in rows]
    for r in rows:
        if len(r) != len(names):
            raise Blocked("FX-ARGUMENT", f"a row has {len(r)} values for {len(names)} columns")
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {type_name(t)}" for n, (_, _, t) in zip(names, fields, strict=True)))


def range_table(spark: SparkSession, start: int, end: int | None = None, step: int = 1) -> DataFrame:
    """Column ``value`` from ``start`` until before ``end``."""
    if end is None:
        start, end = 0, start
    if step == 0:
        raise Blocked("FX-ARGUMENT", "a range needs a step other than zero")
    if not all(INT64[0] <= x <= INT64[1] for x in (start, end, step)):
        raise Blocked("FX-ARGUMENT", "a range is of 64-bit integers")
    return spark.range(start, end, step).withColumnRenamed("id", "value")


def series(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """As ``range_table`` with ``end`` included."""
    return range_table(spark, start, end + (1 if step > 0 else -1), step)


def calendar(spark: SparkSession, first: date | str, last: date | str) -> DataFrame:
    """A row a day from ``first`` to ``last``, both included, with its parts."""
    first, last = (date.fromisoformat(d) if isinstance(d, str) else d for d in (first, last))
    if last < first:
        raise Blocked("FX-ARGUMENT", "a calendar ends before it begins")
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    days = spark.range((last - first).days + 1).select(day.alias("date"))
    return days.select(
        "date",
        F.year("date").alias("year"),
        F.quarter("date").alias("quarter"),
        F.month("date").alias("month"),
        F.day("date").alias("day"),
        (F.weekday("date") + 1).alias("iso_weekday"),
    )
