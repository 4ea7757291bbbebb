"""Profiles, schema checks and rules over a table, each in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomic.errors import Blocked


def profile(df: DataFrame) -> DataFrame:
    """A row a column: rows, nulls, about how many values, least, greatest and mean."""
    plain = [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))]
    if not plain:
        raise Blocked("FX-ARGUMENT", "there is no column to profile")
    measures = [F.count("*").alias("rows")]
    for k, f in enumerate(plain):
        c = F.col(f"`{f.name}`")
        mean = F.avg(c.cast("double")) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        measures += [F.count(c).alias(f"n{k}"), F.approx_count_distinct(c).alias(f"d{k}"), F.min(c).cast("string").alias(f"lo{k}"), F.max(c).cast("string").alias(f"hi{k}"), mean.alias(f"m{k}")]
    one = df.agg(*measures)
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"), (F.col("rows") - F.col(f"n{k}")).alias("nulls"), F.col(f"d{k}").alias("approx_distinct"), F.col(f"lo{k}").alias("min"), F.col(f"hi{k}").alias("max"), F.col(f"m{k}").alias("mean")) for k, f in enumerate(plain)])
    return one.select(F.inline(rows))


def validate_schema(df: DataFrame, expected: str) -> list[str]:
    """What differs from a DDL schema, in words; nothing if all agrees."""
    want = {f.name: f.dataType for f in T._parse_datatype_string(expected)}
    have = {f.name: f.dataType for f in df.schema}
    out = [f"missing column {c}" for c in want if c not in have]
    out += [f"column {c} is {have[c].simpleString()}, not {t.simpleString()}" for c, t in want.items() if c in have and have[c] != t]
    return out + [f"unexpected column {c}" for c in have if c not in want]


def check(df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[str] = (), between: Mapping[str, tuple] | None = None, one_of: Mapping[str, Sequence] | None = None) -> DataFrame:
    """A row a rule: its name, how many rows break it, and whether it holds."""
    measures = [F.count_if(F.col(c).isNull()).alias(f"not_null({c})") for c in not_null]
    measures += [F.count_if(~F.col(c).between(*v)).alias(f"between({c})") for c, v in (between or {}).items()]
    measures += [F.count_if(~F.col(c).isin(*v)).alias(f"one_of({c})") for c, v in (one_of or {}).items()]
    parts = []
    if measures:
        one = df.agg(*measures)
        parts.append(one.unpivot([], one.columns, "rule", "violations"))
    for c in unique:
        twice = df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1")
        parts.append(twice.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations")).select(F.lit(f"unique({c})").alias("rule"), "violations"))
    if not parts:
        raise Blocked("FX-ARGUMENT", "there is no rule to check")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("holds", F.col("violations") == 0)


SCHEMA_CHANGES = ("add", "drop", "rename", "reorder", "widen", "narrow", "retype", "nullability")
_WIDE = ["tinyint", "smallint", "int", "bigint"]


def schema_changes(old: T.StructType, new: T.StructType, renames: Mapping[str, str] | None = None) -> list[tuple[str, str]]:
    """(kind, column) of what changed between two schemas."""
    renames = dict(renames or {})
    was = {renames.get(f.name, f.name): f for f in old}
    now = {f.name: f for f in new}
    out = [("rename", f"{a}->{b}") for a, b in renames.items()]
    out += [("add", c) for c in now if c not in was] + [("drop", c) for c in was if c not in now]
    for c in was.keys() & now.keys():
        a, b = was[c].dataType.simpleString(), now[c].dataType.simpleString()
        if a != b:
            if a in _WIDE and b in _WIDE:
                out.append(("widen" if _WIDE.index(b) > _WIDE.index(a) else "narrow", c))
            elif (a, b) == ("float", "double"):
                out.append(("widen", c))
            elif (a, b) == ("double", "float"):
                out.append(("narrow", c))
            else:
                out.append(("retype", c))
        if was[c].nullable != now[c].nullable:
            out.append(("nullability", c))
    both = [c for c in was if c in now]
    if both != [c for c in now if c in was]:
        out.append(("reorder", ",".join(c for c in now if c in was)))
    return sorted(out)
