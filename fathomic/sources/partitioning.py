"""Partition transforms as derived columns, and byte ranges of stored objects."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomic.errors import Blocked


def transform(column: str, kind: str, width: int | None = None) -> Column:
    """The value of a partition transform: identity, year, month, day, hour, bucket or truncate.

    Year to hour count from 1970; ``bucket`` hashes to ``width`` numbers; ``truncate``
    keeps ``width`` characters of text or rounds whole numbers down to multiples of it.
    """
    c = F.col(column)
    if kind == "identity":
        return c
    if kind in ("bucket", "truncate") and (width is None or width < 1):
        raise Blocked("FX-ARGUMENT", f"{kind} needs a width of at least 1")
    if kind == "bucket":
        return F.pmod(F.xxhash64(c), F.lit(width)).cast("int")
    if kind == "truncate":
        return F.when(F.typeof(c) == "string", F.substring(c.cast("string"), 1, width)).otherwise((c.try_cast("bigint") - F.pmod(c.try_cast("bigint"), F.lit(width))).cast("string"))
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    made = {
        "year": F.year(c) - 1970,
        "month": (F.year(c) - 1970) * 12 + F.month(c) - 1,
        "day": day,
        "hour": day.cast("bigint") * 24 + F.hour(c),
    }
    if kind not in made:
        raise Blocked("FX-ARGUMENT", f"no partition transform {kind}")
    return made[kind]


def write_partitioned(df: DataFrame, path: str, by: dict[str, tuple[str, str, int | None]], overwrite: bool = False) -> None:
    """Parquet folders by named transforms ``name: (column, kind, width)``.

    Rows are dealt out by the partition values first, so a value's rows land in few files.
    """
    out = df.withColumns({name: transform(*spec) for name, spec in by.items()})
    out.repartition(*by).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def read_range(spark: SparkSession, path: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a stored object from ``offset``, through its file system."""
    if offset < 0 or length < 0:
        raise Blocked("FX-ARGUMENT", "a byte range is not negative")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(place).getLen()
    if offset + length > size:
        raise Blocked("FX-ARGUMENT", f"the range ends after the {size} bytes of {path}")
    stream = fs.open(place)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def layout_health(df: DataFrame, small_bytes: int = 32 << 20) -> DataFrame:
    """How many files lie behind a frame, their rows, and how many are small enough to merge."""
    files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count("*").alias("rows"))
    return files.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("file_size").alias("bytes"), F.count_if(F.col("file_size") < small_bytes).alias("small_files"))


def compaction_plan(df: DataFrame, target_bytes: int = 128 << 20) -> DataFrame:
    """Files and the output each would be merged into: small files in path order, filled up to the target."""
    files = df.select("_metadata.file_path", "_metadata.file_size").distinct().filter(F.col("file_size") < target_bytes)
    from pyspark.sql import Window as W

    # a row a file
    running = F.sum("file_size").over(W.orderBy("file_path").rowsBetween(W.unboundedPreceding, W.currentRow))
    return files.withColumn("output", F.floor((running - 1) / F.lit(target_bytes)).cast("int"))


def write_object(spark: SparkSession, path: str, content: bytes) -> dict:
    """Store an object with a commit record beside it, which is written last: readers trust an object only with its record."""
    record = {"length": len(content), "sha256": hashlib.sha256(content).hexdigest()}
    staged = f"{path}.staged"
    _put(spark, staged, content)
    here, fs = _at(spark, path)
    if fs.exists(here):
        fs.delete(here, False)
    if not fs.rename(_at(spark, staged)[0], here):
        raise Blocked("FX-COMMIT", f"{path} could not be put in place")
    _put(spark, f"{path}.commit.json", json.dumps(record).encode())
    return record


def recover_object(spark: SparkSession, path: str) -> str:
    """What became of a write: ``committed``, ``finished`` (the record was missing), ``rolled_back``, ``absent`` or an error if the object is not what its record says.

    A write that stopped before its object was in place is rolled back.
    """
    (here, fs), (staged, _), (record, _) = (_at(spark, p) for p in (path, f"{path}.staged", f"{path}.commit.json"))
    left = fs.exists(staged)
    if left:
        fs.delete(staged, False)
    if not fs.exists(here):
        return "rolled_back" if left else "absent"
    content = read_range(spark, path, 0, fs.getFileStatus(here).getLen())
    found = {"length": len(content), "sha256": hashlib.sha256(content).hexdigest()}
    if not fs.exists(record):
        _put(spark, f"{path}.commit.json", json.dumps(found).encode())
        return "finished"
    told = json.loads(read_range(spark, f"{path}.commit.json", 0, fs.getFileStatus(record).getLen()))
    if told != found:
        raise Blocked("FX-COMMIT", f"{path} is not what its commit record says")
    return "committed"


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    place, fs = _at(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
