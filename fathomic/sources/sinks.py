"""Sinks: staged writes, overwrite policy, fanout."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomic.errors import Blocked
from fathomic.sources.files import exists, infer_format, local_path

#: Arrow IPC files are written by the driver, one batch after the other.
FORMATS = ("csv", "jsonl", "json", "parquet", "orc", "arrow", "native")


def _nested(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]


def check(df: DataFrame, fmt: str) -> None:
    """Whether the sink can hold the columns' types."""
    if fmt == "avro":
        raise Blocked("FX-SOURCE-FORMAT", "Avro needs the external spark-avro module")
    if fmt not in FORMATS:
        raise Blocked("FX-SOURCE-FORMAT", f"{fmt} is not admitted")
    if fmt == "orc":
        bad = _nested(df) + [f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)]
        if bad:
            raise Blocked("FX-SINK-TYPE", f"the ORC sink is flat and without decimals: {', '.join(bad)}")


def _save(df: DataFrame, path: str, fmt: str) -> None:
    if fmt == "csv":
        nested = _nested(df)
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        df.write.option("header", "true").csv(path)
    elif fmt in ("jsonl", "json"):
        df.write.option("ignoreNullFields", "false").json(path)
    elif fmt == "orc":
        df.write.orc(path)
    elif fmt == "arrow":
        schema = df.limit(0).toArrow().schema

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pa.Table.from_batches([b]).cast(schema).combine_chunks().to_batches()[0].serialize().to_pybytes()] if b.num_rows else [], pa.binary())], names=["batch"])

        # the driver holds the batches of one partition at a time
        with pa.OSFile(local_path(path), "wb") as f, pa.ipc.new_file(f, schema) as w:
            for row in df.mapInArrow(packed, "batch binary").toLocalIterator():
                w.write_batch(pa.ipc.read_record_batch(pa.py_buffer(row["batch"]), schema))
    else:
        df.write.parquet(path)


def write(df: DataFrame, path: str, fmt: str | None = None, overwrite: bool = False) -> str:
    """Write beside the target, then rename: readers see all of it or nothing."""
    return fanout(df, {path: fmt}, overwrite)[0]


def fanout(df: DataFrame, targets: Mapping[str, str | None], overwrite: bool = False) -> list[str]:
    """One result to many sinks; on a failure none of them appears, and what was there before stays.

    The result is computed once if there is more than one sink. A target that is
    replaced is set aside until all are in place.
    """
    spark = df.sparkSession
    wanted = {p: f or infer_format(p) for p, f in targets.items()}
    for path, fmt in wanted.items():
        check(df, fmt)
        if exists(spark, path) and not overwrite:
            raise Blocked("FX-SINK-EXISTS", f"{path} exists; ask for overwriting to replace it")
    jvm = spark._jvm
    held = df.persist() if len(wanted) > 1 else df
    staged: dict[str, str] = {}
    aside: dict[str, str] = {}
    placed: list[str] = []

    def place(path: str):
        out = jvm.org.apache.hadoop.fs.Path(path)
        return out, out.getFileSystem(spark._jsc.hadoopConfiguration())

    def move(source: str, target: str) -> None:
        own, fs = place(source)
        if not fs.rename(own, place(target)[0]):
            raise Blocked("FX-COMMIT", f"{target} could not be put in place")

    def drop(path: str) -> None:
        own, fs = place(path)
        if fs.exists(own):
            fs.delete(own, True)

    try:
        for path, fmt in wanted.items():
            staged[path] = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
            _save(held, staged[path], fmt)
        for path, temp in staged.items():
            if exists(spark, path):
                old = f"{path.rstrip('/')}.replaced-{uuid.uuid4().hex}"
                move(path, old)
                aside[path] = old
            move(temp, path)
            placed.append(path)
    except BaseException:
        for path in placed:
            drop(path)
        for path, old in aside.items():
            move(old, path)
        for temp in staged.values():
            drop(temp)
        raise
    else:
        for old in aside.values():
            drop(old)
    finally:
        if held is not df:
            held.unpersist()
    return list(wanted)


def write_native(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """A typed Parquet write that is opened again: its rows, after schema and count agree."""
    spark = df.sparkSession
    held = df.persist()
    try:
        count = held.count()
        write(held, path, "native", overwrite)
    finally:
        held.unpersist()
    again = spark.read.parquet(path)
    if [t for _, t in again.dtypes] != [t for _, t in df.dtypes] or again.count() != count:
        raise Blocked("FX-COMMIT", f"{path} doesn't read back as it was written")
    return count
