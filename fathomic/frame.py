"""Lazy frames: an immutable DataFrame with the engine's operators and result envelopes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomic.errors import Blocked
from fathomic.operators import dedup, picking, reshape, rolling
from fathomic.operators.order import with_row_index

if TYPE_CHECKING:
    from fathomic.evidence import Result
    from fathomic.session import Session

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "semi": "left_semi", "anti": "left_anti", "left_semi": "left_semi", "left_anti": "left_anti"}


def sort_columns(by: Sequence[str], ascending: bool | Sequence[bool] = True, nulls: str | Sequence[str] | None = None) -> list[Column]:
    """Sort keys with the place of nulls written out: first when ascending unless told otherwise."""
    up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    where = [nulls] * len(by) if nulls is None or isinstance(nulls, str) else list(nulls)
    out = []
    for c, a, n in zip(by, up, where, strict=True):
        col = F.col(c)
        n = n or ("first" if a else "last")
        out.append((col.asc_nulls_first() if n == "first" else col.asc_nulls_last()) if a else (col.desc_nulls_first() if n == "first" else col.desc_nulls_last()))
    return out


class Frame:
    """Operations return new frames; nothing runs until rows are asked for, within a limit."""

    def __init__(self, df: DataFrame, session: Session, source: str | None = None, bounded: bool = False) -> None:
        self.df, self.session, self.source, self.bounded = df, session, source, bounded

    def _with(self, df: DataFrame, bounded: bool | None = None) -> Frame:
        return Frame(df, self.session, self.source, self.bounded if bounded is None else bounded)

    def _need(self, *columns: str) -> None:
        missing = [c for c in columns if c not in self.df.columns]
        if missing:
            raise Blocked("FX-COLUMN", f"no column {', '.join(missing)}")

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    # Projection and filters

    def select(self, *columns: str | Column) -> Frame:
        if "*" in [c for c in columns if isinstance(c, str)]:
            own = [c for c in self.columns if not c.startswith("__")]
            columns = tuple(x for c in columns for x in (own if isinstance(c, str) and c == "*" else [c]))
        self._need(*[c for c in columns if isinstance(c, str)])
        return self._with(self.df.select(*columns))

    def with_column(self, name: str, value: Column) -> Frame:
        return self._with(self.df.withColumn(name, value))

    def with_columns(self, **values: Column) -> Frame:
        return self._with(self.df.withColumns(values))

    assign = with_columns

    def rename(self, names: Mapping[str, str]) -> Frame:
        self._need(*names)
        return self._with(self.df.withColumnsRenamed(dict(names)))

    def drop(self, *columns: str) -> Frame:
        self._need(*columns)
        return self._with(self.df.drop(*columns))

    def astype(self, kinds: Mapping[str, str]) -> Frame:
        from fathomic.functions import scalar
        from fathomic.sources.generated import type_name

        self._need(*kinds)
        now = dict(self.df.dtypes)
        return self._with(self.df.withColumns({c: scalar.cast(c, now[c], type_name(t)) for c, t in kinds.items()}))

    def filter(self, condition: Column | str) -> Frame:
        return self._with(self.df.filter(condition))

    where = query = filter

    def mask(self, condition: Column, value: Any, *columns: str) -> Frame:
        """Where the condition is TRUE, the columns take the value."""
        self._need(*columns)
        return self._with(self.df.withColumns({c: F.when(condition, F.lit(value)).otherwise(F.col(c)) for c in columns or self.columns}))

    def replace(self, old: Any, new: Any, *columns: str) -> Frame:
        """Whole cells equal to ``old`` become ``new``."""
        kind = type(old)
        own = columns or [f.name for f in self.schema if _fits(f.dataType, kind)]
        return self._with(self.df.withColumns({c: F.when(F.col(c).eqNullSafe(F.lit(old)), F.lit(new)).otherwise(F.col(c)) for c in own}))

    def str_replace(self, column: str, old: str, new: str, regex: bool = False) -> Frame:
        from fathomic.functions import scalar

        self._need(column)
        value = scalar.regexp_replace(column, old, new) if regex else scalar.replace(column, F.lit(old), F.lit(new))
        return self._with(self.df.withColumn(column, value))

    def arithmetic(self, column: str, op: str, value: int | float, name: str | None = None) -> Frame:
        """One of ``+ - * /`` with a scalar; whole numbers divide truncating."""
        from fathomic.functions import scalar

        self._need(column)
        whole = dict(self.df.dtypes)[column] in ("bigint", "int", "smallint", "tinyint") and isinstance(value, int)
        c = F.col(column)
        out = {"+": lambda: c + value, "-": lambda: c - value, "*": lambda: c * value, "/": lambda: scalar.int_divide(c, F.lit(value)) if whole else scalar.float_op(c, "/", F.lit(value))}
        if op not in out:
            raise Blocked("FX-ARGUMENT", f"no operation {op}")
        return self._with(self.df.withColumn(name or column, out[op]()))

    def fillna(self, value: Any = None, **by_column: Any) -> Frame:
        values = by_column or {f.name: value for f in self.schema if _fits(f.dataType, type(value))}
        self._need(*values)
        return self._with(self.df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()}))

    fill_null = fillna

    def dropna(self, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> Frame:
        if how not in ("any", "all"):
            raise Blocked("FX-ARGUMENT", "how is any or all")
        return self._with(self.df.dropna(how, thresh, list(subset) if subset else None))

    def isna(self, *columns: str) -> Frame:
        return self._with(self.df.select(*[F.col(c).isNull().alias(c) for c in columns or self.columns]))

    def notna(self, *columns: str) -> Frame:
        return self._with(self.df.select(*[F.col(c).isNotNull().alias(c) for c in columns or self.columns]))

    def ffill(self, column: str, limit: int | None = None, by: list[str] | None = None, order: list[str] | None = None) -> Frame:
        self._need(column)
        return self._with(rolling.ffill(self.df, column, limit, by, order))

    def map(self, column: str, transform: Callable[[Column], Column]) -> Frame:
        """A declarative transform of a column; Python functions over values are blocked."""
        out = transform(F.col(column))
        if not isinstance(out, Column):
            raise Blocked("FX-UDF", "a transform must return a column expression")
        return self._with(self.df.withColumn(column, out))

    def applymap(self, transform: Callable[[Column], Column]) -> Frame:
        return self._with(self.df.select(*[transform(F.col(c)).alias(c) for c in self.columns]))

    def pipe(self, fn: Callable[..., Frame], *args: Any, **options: Any) -> Frame:
        out = fn(self, *args, **options)
        if not isinstance(out, Frame):
            raise Blocked("FX-UDF", "a piped function must return a frame")
        return out

    apply = pipe

    # Joins and set operations

    def join(self, other: Frame, on: str | Sequence[str] | Column | None = None, how: str = "inner", suffix: str = "_right", hint: str | None = None) -> Frame:
        """Equi-join on names, a join on a condition, or a cross join; complex keys are blocked.

        ``hint``: ``merge``, ``shuffle_hash`` or ``broadcast``, the last for a bounded other side alone.

        The result is bounded if both sides are, or if it only picks rows of a bounded side.
        """
        both, plain = self.bounded and other.bounded, other.df
        if hint is not None:
            if hint not in ("merge", "shuffle_hash", "broadcast"):
                raise Blocked("FX-ARGUMENT", f"no join hint {hint}")
            if hint == "broadcast" and not other.bounded:
                raise Blocked("FX-UNBOUNDED", "only a bounded side is broadcast")
            other = other._with(other.df.hint(hint))
        if how == "cross":
            return self._with(self.df.crossJoin(other._renamed(self, (), suffix)), both)
        if how not in HOW:
            raise Blocked("FX-ARGUMENT", f"no join {how}")
        picks = HOW[how] in ("left_semi", "left_anti")
        if isinstance(on, Column):
            return self._with(self.df.join(other.df, on, HOW[how]), self.bounded if picks else both)
        keys = [on] if isinstance(on, str) else list(on or ())
        if not keys:
            raise Blocked("FX-ARGUMENT", "a join needs keys or a condition")
        self._need(*keys)
        other._need(*keys)
        for c in keys:
            if isinstance(self.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)):
                raise Blocked("FX-TYPE", f"{c} is nested and cannot be a join key")
        if picks:
            # each key once, so that a frequent one doesn't pile up in one task
            right = plain.select(*[f"`{c}`" for c in keys]).distinct()
            right = right if hint is None else right.hint(hint)
        else:
            right = other._renamed(self, keys, suffix)
        return self._with(self.df.join(right, keys, HOW[how]), self.bounded if picks else both)

    merge = join

    def _renamed(self, left: Frame, keys: Sequence[str], suffix: str) -> DataFrame:
        return self.df.withColumnsRenamed({c: c + suffix for c in self.columns if c in left.columns and c not in keys})

    def _same_types(self, other: Frame) -> None:
        if [f.dataType for f in self.schema] != [f.dataType for f in other.schema]:
            raise Blocked("FX-SOURCE-SCHEMA", "the branches differ in types")

    def union(self, other: Frame) -> Frame:
        self._same_types(other)
        return self._with(self.df.union(other.df).distinct(), False)

    def union_all(self, other: Frame) -> Frame:
        self._same_types(other)
        return self._with(self.df.union(other.df), False)

    concat = union_all

    def intersect(self, other: Frame) -> Frame:
        self._same_types(other)
        return self._with(self.df.intersect(other.df))

    def subtract(self, other: Frame) -> Frame:
        self._same_types(other)
        return self._with(self.df.subtract(other.df))

    # Duplicates

    def distinct(self) -> Frame:
        return self._with(self.df.distinct())

    unique = distinct

    def drop_duplicates(self, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None) -> Frame:
        return self._with(dedup.drop_duplicates(self.df, subset, keep, order))

    def duplicated(self, subset: list[str] | None = None, keep: str | bool = "first", order: list[str] | None = None) -> Frame:
        return self._with(dedup.duplicated(self.df, subset, keep, order))

    # Aggregates

    def group_by(self, *keys: str | Column) -> Grouped:
        self._need(*[k for k in keys if isinstance(k, str)])
        return Grouped(self, keys)

    groupby = group_by

    def agg(self, *measures: Column) -> Frame:
        return self._with(self.df.agg(*measures), True)

    def count(self) -> int:
        return self.df.count()

    def count_where(self, condition: Column | str) -> int:
        return self.df.filter(condition).count()

    def nunique(self, *columns: str) -> Frame:
        return self._with(self.df.agg(*[F.count_distinct(c).alias(c) for c in columns or self.columns]), True)

    def value_counts(self, *columns: str, dropna: bool = True) -> Frame:
        """Rows of each value as ``rows``, most first."""
        self._need(*columns)
        df = self.df.dropna(subset=list(columns)) if dropna else self.df
        return self._with(df.groupBy(*columns).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), *columns))

    def describe(self) -> Frame:
        from fathomic.operators import quality

        return self._with(quality.profile(self.df), True)

    profile = describe

    # Order and limits

    def sort(self, *by: str, ascending: bool | Sequence[bool] = True, nulls: str | Sequence[str] | None = None) -> Frame:
        self._need(*by)
        return self._with(self.df.orderBy(*sort_columns(by, ascending, nulls)))

    order_by = sort_by = sort_values = sort

    def limit(self, n: int, offset: int = 0) -> Frame:
        if n < 0 or offset < 0:
            raise Blocked("FX-ARGUMENT", "a count is not negative")
        df = self.df.offset(offset) if offset else self.df
        return self._with(df.limit(n), True)

    head = take = limit

    def tail(self, n: int, order: list[str] | None = None) -> Frame:
        return self._with(picking.tail(self.df, n, order), True)

    def top(self, n: int, by: Sequence[str], ascending: bool | Sequence[bool] = False, offset: int = 0) -> Frame:
        return self.sort(*by, ascending=ascending, nulls="last").limit(n, offset)

    def sample(self, n: int | None = None, fraction: float | None = None, seed: int = 0, weights: str | None = None, replace: bool = False, key: list[str] | None = None) -> Frame:
        return self._with(picking.sample(self.df, n, fraction, seed, weights, replace, key), n is not None)

    def nlargest(self, n: int, columns: str | Sequence[str], keep: str = "first", order: list[str] | None = None) -> Frame:
        by = [columns] if isinstance(columns, str) else list(columns)
        return self._with(picking.n_extreme(self.df, n, by, True, keep, order), True)

    def nsmallest(self, n: int, columns: str | Sequence[str], keep: str = "first", order: list[str] | None = None) -> Frame:
        by = [columns] if isinstance(columns, str) else list(columns)
        return self._with(picking.n_extreme(self.df, n, by, False, keep, order), True)

    def top_per_group(self, by: list[str], n: int, order: list) -> Frame:
        return self._with(picking.top_per_group(self.df, by, n, order))

    def row_number(self, name: str = "row_number", start: int = 1) -> Frame:
        """Numbers in source order."""
        return self._with(with_row_index(self.df, name, start))

    def set_index(self, *columns: str) -> Frame:
        """Indexes are plain columns: the named ones come first."""
        self._need(*columns)
        return self._with(self.df.select(*columns, *[c for c in self.columns if c not in columns]))

    def reset_index(self, name: str = "index") -> Frame:
        out = with_row_index(self.df, name)
        return self._with(out.select(name, *self.columns))

    def sort_index(self, *columns: str) -> Frame:
        return self.sort(*(columns or self.columns[:1]))

    # Windows and reshaping

    def rolling(self, column: str, window: int, min_periods: int | None = None, center: bool = False, by: list[str] | None = None, order: list[str] | None = None) -> Rolling:
        self._need(column)
        return Rolling(self, column, {"window": window, "min_periods": min_periods, "center": center, "by": by, "order": order})

    def melt(self, ids: list[str], values: list[str] | None = None, var_name: str = "variable", value_name: str = "value") -> Frame:
        return self._with(reshape.melt(self.df, ids, values, var_name, value_name))

    def explode(self, *columns: str, keep_empty: bool = True) -> Frame:
        self._need(*columns)
        # a list may hold any number of rows
        return self._with(reshape.explode(self.df, list(columns), keep_empty), False)

    def pivot(self, index: list[str], columns: str, values: str, names: list | None = None) -> Frame:
        return self._with(reshape.pivot(self.df, index, columns, values, names))

    def pivot_table(self, index: list[str], columns: str, values: str, agg: str = "mean", **options: Any) -> Frame:
        return self._with(reshape.pivot_table(self.df, index, columns, values, agg, **options))

    # Quality

    def validate_schema(self, expected: str) -> list[str]:
        from fathomic.operators import quality

        return quality.validate_schema(self.df, expected)

    def data_quality(self, **rules: Any) -> Frame:
        from fathomic.operators import quality

        return self._with(quality.check(self.df, **rules), True)

    # Results

    def _bounded(self) -> DataFrame:
        if not self.bounded:
            raise Blocked("FX-UNBOUNDED", "ask for rows with a limit, or write them to a sink")
        return self.df

    def collect(self) -> Result:
        from fathomic.evidence import Result

        return Result.of(self._bounded(), self.source)

    def preview(self, n: int = 10) -> Result:
        return self.limit(n).collect()

    def to_pylist(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._bounded().collect()]

    def to_pandas(self):
        return self._bounded().toPandas()

    def to_arrow(self):
        return self._bounded().toArrow()

    def to_numpy(self):
        return self._bounded().toPandas().to_numpy()

    def write(self, path: str, fmt: str | None = None, overwrite: bool = False) -> str:
        from fathomic.sources import sinks

        return sinks.write(self.df, path, fmt, overwrite)

    def write_csv(self, path: str, overwrite: bool = False) -> str:
        return self.write(path, "csv", overwrite)

    def write_jsonl(self, path: str, overwrite: bool = False) -> str:
        return self.write(path, "jsonl", overwrite)

    def write_parquet(self, path: str, overwrite: bool = False) -> str:
        return self.write(path, "parquet", overwrite)

    def write_orc(self, path: str, overwrite: bool = False) -> str:
        return self.write(path, "orc", overwrite)

    def write_arrow(self, path: str, overwrite: bool = False) -> str:
        return self.write(path, "arrow", overwrite)

    def write_avro(self, path: str, overwrite: bool = False) -> str:
        return self.write(path, "avro", overwrite)

    def write_native(self, path: str, overwrite: bool = False) -> int:
        from fathomic.sources import sinks

        return sinks.write_native(self.df, path, overwrite)

    def fanout(self, targets: Mapping[str, str | None], overwrite: bool = False) -> list[str]:
        from fathomic.sources import sinks

        return sinks.fanout(self.df, targets, overwrite)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)


class Grouped:
    """Group keys that wait for measures."""

    def __init__(self, frame: Frame, keys: Sequence[str | Column]) -> None:
        self.frame, self.keys = frame, keys

    def agg(self, *measures: Column, having: Column | None = None) -> Frame:
        out = self.frame.df.groupBy(*self.keys).agg(*measures)
        return self.frame._with(out.filter(having) if having is not None else out)

    def count(self) -> Frame:
        return self.agg(F.count("*").alias("rows"))

    def _each(self, fn: Callable, columns: Sequence[str]) -> Frame:
        return self.agg(*[fn(c).alias(c) for c in columns])

    def sum(self, *columns: str) -> Frame:
        return self._each(F.sum, columns)

    def mean(self, *columns: str) -> Frame:
        return self._each(F.avg, columns)

    avg = mean

    def min(self, *columns: str) -> Frame:
        return self._each(F.min, columns)

    def max(self, *columns: str) -> Frame:
        return self._each(F.max, columns)

    def nunique(self, *columns: str) -> Frame:
        return self._each(F.count_distinct, columns)


class Rolling:
    """A rolling window that waits for its function."""

    def __init__(self, frame: Frame, column: str, options: dict) -> None:
        self.frame, self.column, self.options = frame, column, options

    def _run(self, fn: str, name: str | None) -> Frame:
        return self.frame._with(rolling.rolling(self.frame.df, self.column, fn, name=name, **self.options))

    def sum(self, name: str | None = None) -> Frame:
        return self._run("sum", name)

    def mean(self, name: str | None = None) -> Frame:
        return self._run("mean", name)

    def count(self, name: str | None = None) -> Frame:
        return self._run("count", name)

    def min(self, name: str | None = None) -> Frame:
        return self._run("min", name)

    def max(self, name: str | None = None) -> Frame:
        return self._run("max", name)


def _fits(kind: T.DataType, value: type) -> bool:
    if value is bool:
        return isinstance(kind, T.BooleanType)
    if value in (int, float):
        return isinstance(kind, T.NumericType)
    return isinstance(kind, T.StringType) if value is str else False
