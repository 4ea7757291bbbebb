"""File sources: suffix inference, parts, partitions, derived columns."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomic.errors import Blocked

#: Suffix to format.
SUFFIXES = {
    "csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet",
    "arrow": "arrow", "ipc": "arrow", "feather": "arrow", "avro": "avro", "orc": "orc",
}
_REMOTE = {"http", "https", "jdbc", "ftp"}


def infer_format(path: str) -> str:
    """The format a path's suffix stands for; a folder without suffix is a set of Parquet parts."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in name:
        return "parquet"
    fmt = SUFFIXES.get(name.rsplit(".", 1)[-1].lower())
    if fmt is None:
        raise Blocked("FX-SOURCE-FORMAT", f"no format for the suffix of {path}")
    return fmt


def check_scheme(path: str) -> None:
    if urlparse(path).scheme.lower() in _REMOTE:
        raise Blocked("FX-SOURCE-REMOTE", f"{path} is not a file system path")


def local_path(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise Blocked("FX-SOURCE-REMOTE", f"{path} is not a local path")
    return parsed.path if parsed.scheme else path


def exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def read(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, fmt: str | None = None, **options: str) -> DataFrame:
    """A lazy scan. Empty CSV cells are null; JSON is one document a file, JSONL one a line."""
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        check_scheme(p)
    fmt = fmt or infer_format(paths[0])
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header="true", nullValue="", emptyValue="", enforceSchema="false")
        if not schema:
            reader = reader.option("inferSchema", "true")
        return _null_to_string(reader.csv(paths))
    if fmt == "json":
        return reader.option("multiLine", "true").json(paths)
    if fmt == "jsonl":
        return reader.json(paths)
    if fmt == "parquet":
        return reader.parquet(*paths)
    if fmt == "orc":
        return reader.orc(paths)
    if fmt == "arrow":
        return _read_arrow(spark, paths)
    if fmt == "avro":
        raise Blocked("FX-SOURCE-FORMAT", "Avro needs the external spark-avro module")
    raise Blocked("FX-SOURCE-FORMAT", f"{fmt} is not admitted")


def _null_to_string(df: DataFrame) -> DataFrame:
    """A column without values is text."""
    void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    return df.withColumns({c: F.col(c).cast("string") for c in void}) if void else df


def _read_arrow(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Arrow IPC files or streams, read on the executors a batch at a time."""

    def schema_of(batches):
        for b in batches:
            for content in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([_open_arrow(content.as_py()).schema.serialize().to_pybytes()])], names=["schema"])

    # only the first file's schema reaches the driver
    found = spark.read.format("binaryFile").load(paths).select("content").limit(1).mapInArrow(schema_of, "schema binary").first()
    if found is None:
        raise Blocked("FX-SOURCE-FORMAT", "no Arrow file to read")
    empty = pa.ipc.read_schema(pa.py_buffer(found["schema"])).empty_table()
    schema = T.StructType.fromJson(spark.createDataFrame(empty).schema.jsonValue())

    def run(batches):
        for b in batches:
            for content in b.column(0):
                reader = _open_arrow(content.as_py())
                for k in range(reader.num_record_batches) if hasattr(reader, "num_record_batches") else range(0):
                    yield reader.get_batch(k)
                if not hasattr(reader, "num_record_batches"):
                    yield from reader

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, schema)


def _open_arrow(content: bytes):
    try:
        return pa.ipc.open_file(pa.BufferReader(content))
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(pa.BufferReader(content))


def read_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    twice = sorted({p for p in paths if list(paths).count(p) > 1})
    if twice:
        raise Blocked("FX-SOURCE-DUPLICATE", f"listed more than once: {', '.join(twice)}")
    if not paths:
        raise Blocked("FX-ARGUMENT", "a table needs at least one part")
    schemas = {p: spark.read.parquet(p).schema for p in paths}
    first = schemas[paths[0]]
    for p, s in schemas.items():
        if [(f.name, f.dataType) for f in s] != [(f.name, f.dataType) for f in first]:
            raise Blocked("FX-SOURCE-SCHEMA", f"{p} differs in schema from {paths[0]}")
    return spark.read.parquet(*paths)


def read_partitioned(spark: SparkSession, path: str, expected: Sequence[str] = ()) -> DataFrame:
    df = spark.read.option("basePath", path).parquet(path)
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise Blocked("FX-COLUMN", f"no partition column {', '.join(missing)} under {path}")
    return df


def with_derived(df: DataFrame) -> DataFrame:
    """Columns that queries often compute, computed once: ``__len_``, ``__domain_``, ``__minute_`` and ``__bucket_``."""
    from fathomic.functions import scalar

    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            out[f"__len_{f.name}"] = F.char_length(f.name)
            out[f"__domain_{f.name}"] = scalar.url_domain(F.col(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f"__minute_{f.name}"] = F.minute(f.name)
            out[f"__bucket_{f.name}"] = F.date_trunc("minute", f.name)
    return df.withColumns(out) if out else df


def visible(df: DataFrame) -> DataFrame:
    """Without the derived columns, as ``*`` means it."""
    return df.select([c for c in df.columns if not c.startswith("__")])
