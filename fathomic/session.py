"""Sessions: Spark settings, sources, generated tables, SQL and prepared state."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from fathomic.errors import Blocked
from fathomic.frame import Frame
from fathomic.sources import files, generated, lakes, sqlite_table

#: ANSI arithmetic (overflow is an error) and UTC are part of the semantics; the rest is for scale.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def spark_session(master: str | None = None, **settings: str) -> SparkSession:
    """A Spark session with the engine's settings; ``settings`` use ``_`` for ``.``."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("_", "."): str(v) for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Session:
    """The front door: reads sources into lazy frames and runs SQL over them."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or spark_session()
        for key, value in SETTINGS.items():
            if key.startswith("spark.sql."):
                self.spark.conf.set(key, value)
        self._prepared: dict[str, str] = {}

    def frame(self, df: DataFrame, source: str | None = None) -> Frame:
        return Frame(df, self, source=source)

    # Sources

    def read(self, path: str | Sequence[str], schema: str | None = None, fmt: str | None = None, **options: str) -> Frame:
        """Read a path, its format inferred from the suffix."""
        return self.frame(files.read(self.spark, path, schema, fmt, **options), source=str(path))

    def read_csv(self, path: str, schema: str | None = None, **options: str) -> Frame:
        return self.read(path, schema, "csv", **options)

    def read_json(self, path: str, schema: str | None = None, **options: str) -> Frame:
        return self.read(path, schema, "json", **options)

    def read_jsonl(self, path: str, schema: str | None = None, **options: str) -> Frame:
        return self.read(path, schema, "jsonl", **options)

    def read_parquet(self, path: str | Sequence[str]) -> Frame:
        return self.read(path, fmt="parquet")

    def read_orc(self, path: str) -> Frame:
        return self.read(path, fmt="orc")

    def read_arrow(self, path: str) -> Frame:
        return self.read(path, fmt="arrow")

    def read_avro(self, path: str) -> Frame:
        return self.read(path, fmt="avro")

    def read_parts(self, paths: Sequence[str]) -> Frame:
        """Many part files as one table; a part listed twice is an error."""
        return self.frame(files.read_parts(self.spark, paths), source=",".join(paths))

    def read_partitioned(self, path: str, expected: Sequence[str] = ()) -> Frame:
        """A tree of ``key=value`` folders; ``expected`` names the partition columns it must have."""
        return self.frame(files.read_partitioned(self.spark, path, expected), source=path)

    def read_sqlite(self, path: str, table: str) -> Frame:
        return self.frame(sqlite_table.read(self.spark, path, table), source=f"{path}#{table}")

    def read_delta(self, path: str, version: int | None = None) -> Frame:
        return self.frame(lakes.read_delta(self.spark, path, version), source=path)

    def read_iceberg(self, path: str, snapshot_id: int | None = None, as_of_ms: int | None = None) -> Frame:
        return self.frame(lakes.read_iceberg(self.spark, path, snapshot_id, as_of_ms), source=path)

    # Generated tables

    def from_rows(self, rows: Iterable[Sequence], schema: str) -> Frame:
        """Literal rows; ``schema`` as ``name:type,...``."""
        return self.frame(generated.from_rows(self.spark, rows, schema))

    def range(self, start: int, end: int | None = None, step: int = 1) -> Frame:
        return self.frame(generated.range_table(self.spark, start, end, step))

    sequence = range

    def calendar(self, first: date | str, last: date | str) -> Frame:
        return self.frame(generated.calendar(self.spark, first, last))

    # SQL

    def sql(self, statement: str, inputs: Mapping[str, Frame | DataFrame | str] | None = None, allow_all: bool = False) -> Frame:
        """Run an admitted statement over named inputs and quoted file paths."""
        from fathomic.plans import sql

        out = self.frame(sql.run(self, statement, inputs or {}, allow_all))
        out.bounded = sql.bounded(statement)
        return out

    # Prepared state

    def fingerprint(self, path: str) -> str:
        """Digest of a source's file names, sizes and times, from its file system's listing."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            raise Blocked("FX-SQL-BINDING", f"{path} does not exist")
        found = []
        it = fs.listFiles(root, True)
        while it.hasNext():
            s = it.next()
            found.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()

    def prepare(self, path: str, target: str, overwrite: bool = False, derived: bool = False, schema: str | None = None) -> Frame:
        """Rewrite a source once as Parquet under ``target``; an unchanged source is reused.

        ``derived``: add hidden columns of string lengths, URL domains and minutes.
        """
        from fathomic.sources import sinks

        mark = self.fingerprint(path)
        place = f"{target.rstrip('/')}/{mark[:16]}{'-derived' if derived else ''}"
        if files.exists(self.spark, place) and not overwrite:
            return self.frame(self.spark.read.parquet(place), source=path)
        df = files.read(self.spark, path, schema)
        if derived:
            df = files.with_derived(df)
        sinks.write(df, place, "parquet", overwrite=True)
        self._prepared[path] = place
        return self.frame(self.spark.read.parquet(place), source=path)

    # Capabilities

    def capabilities(self) -> dict[str, dict[str, str]]:
        from fathomic.plans.capabilities import CAPABILITIES

        return {k: dict(v) for k, v in CAPABILITIES.items()}
