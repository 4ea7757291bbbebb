"""Change streams of (key, op, sequence, offset, event_time, ...) records.

``append`` and ``upsert`` set a key; ``delete``, ``retract`` and ``tombstone`` remove it. The
batch forms are exact and need one shuffle by key; the streaming forms keep the same
state with Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomic.errors import Blocked
from fathomic.operators.order import numbered

SETS = ("append", "upsert")
REMOVES = ("delete", "retract", "tombstone")
#: What a change feed may tell of; only the first four change rows.
EVENT_KINDS = ("insert", "update", "delete", "tombstone", "schema_change", "partition_change", "metadata_only", "unknown")
MODES = ("append", "update", "complete")


def check_ops(df: DataFrame, op: str = "op") -> DataFrame:
    """``df``, failing at run time on an unknown operation."""
    known = F.col(op).isin(*SETS, *REMOVES)
    return df.withColumn(op, F.when(known, F.col(op)).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null"))))))


def event_kind(op: str = "op") -> Column:
    """The kind of a feed's record by its operation, in any case; what is not known is ``unknown``."""
    word = F.lower(F.trim(F.col(op)))
    by = {"insert": ("insert", "append", "i", "c", "r"), "update": ("update", "upsert", "u"), "delete": ("delete", "retract", "d"), "tombstone": ("tombstone",), "schema_change": ("schema_change", "schema"), "partition_change": ("partition_change", "partition"), "metadata_only": ("metadata_only", "metadata")}
    out = F.lit("unknown")
    for kind, words in by.items():
        out = F.when(word.isin(*words), kind).otherwise(out)
    return out


def row_events(df: DataFrame, op: str = "op") -> DataFrame:
    """Records that change rows, with the operations that state is kept by; an unknown kind fails at run time."""
    kind = event_kind(op)
    known = F.when(kind == "unknown", F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null"))))).otherwise(kind)
    named = df.withColumn(op, known).filter(F.col(op).isin(*EVENT_KINDS[:4]))
    return named.withColumn(op, F.when(F.col(op) == "insert", "append").when(F.col(op) == "update", "upsert").otherwise(F.col(op)))


def replay_dedup(df: DataFrame, offset: str = "offset", sequence: str = "sequence") -> DataFrame:
    """Each (offset, sequence) pair once: a replayed record changes nothing."""
    return df.dropDuplicates([offset, sequence])


def state(df: DataFrame, key: str = "key", op: str = "op", order: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """The rows that are left: each key's last record, unless it removes the key.

    The last record is an aggregate, so a hot key is reduced before it moves.
    """
    rest = [c for c in df.columns if c != key]
    last = check_ops(df, op).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    out = last.filter(F.col(f"__last.{op}").isin(*SETS))
    return out.select(*[F.col(key) if c == key else F.col(f"__last.{c}").alias(c) for c in df.columns])


def late(df: DataFrame, event_time: str, order: list[str], delay: int = 0, by: str | None = None) -> DataFrame:
    """``df`` with ``is_late``: whether a record is older than the greatest event time before it less ``delay``.

    Without ``by`` the running maximum is over the whole stream: maxima of blocks of rows
    are carried forward, so no task reads all of them.
    """
    if by:
        spec = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        seen = F.max(event_time).over(spec)
        return df.withColumn("is_late", F.coalesce(F.col(event_time) < seen - F.lit(delay), F.lit(False)))
    rows = numbered(df, order).withColumn("__block", F.floor(F.col("__row") / 65_536).cast("long"))
    peaks = rows.groupBy("__block").agg(F.max(event_time).alias("__peak"))
    # a row for each block of 65,536 records
    before = peaks.withColumn("__before", F.max("__peak").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))).select("__block", "__before")
    inside = F.max(event_time).over(W.partitionBy("__block").orderBy("__row").rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumn("__inside", inside).join(before, "__block", "left")
    seen = F.greatest("__inside", "__before")
    return out.withColumn("is_late", F.coalesce(F.col(event_time) < seen - F.lit(delay), F.lit(False))).select(*df.columns, "is_late")


def late_count(df: DataFrame, event_time: str, order: list[str], delay: int = 0) -> DataFrame:
    return late(df, event_time, order, delay).agg(F.count_if("is_late").alias("late"), F.count("*").alias("records"), F.max(event_time).alias("watermark"))


def hybrid(base: DataFrame, delta: DataFrame, key: str = "key", op: str = "op", order: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """The base table under the delta: the delta's last word on a key wins; removed keys go."""
    rest = [c for c in base.columns if c != key]
    last = check_ops(delta, op).groupBy(key).agg(F.max_by(F.struct(op, *rest), F.struct(*order)).alias("__d"))
    both = base.join(last, key, "full")
    changed = F.col("__d").isNotNull()
    out = both.filter(~changed | F.col(f"__d.{op}").isin(*SETS))
    return out.select(*[F.col(key) if c == key else F.when(changed, F.col(f"__d.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])


def hybrid_counts(base: DataFrame, delta: DataFrame, key: str = "key", op: str = "op", order: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """How many base rows the delta removes, replaces and leaves, and how many keys it adds."""
    last = check_ops(delta, op).groupBy(key).agg(F.max_by(F.col(op), F.struct(*order)).alias("__op"))
    both = base.select(key, F.lit(True).alias("__base")).join(last, key, "full")
    removes = F.col("__op").isin(*REMOVES)
    old = F.col("__base").isNotNull()
    return both.agg(
        F.count_if(old & removes).alias("removed"),
        F.count_if(old & F.col("__op").isNotNull() & ~removes).alias("replaced"),
        F.count_if(old & F.col("__op").isNull()).alias("kept"),
        F.count_if(~old & ~removes).alias("added"),
    )


# Structured Streaming


def stream_counts(stream: DataFrame, group: list[str], where: str | None = None) -> DataFrame:
    """Counts of groups over a stream, for modes ``update`` and ``complete``."""
    rows = stream.filter(where) if where else stream
    return rows.groupBy(*group).agg(F.count("*").alias("rows"))


def stream_dedup(stream: DataFrame, event_time: str, delay: str, keys: list[str]) -> DataFrame:
    """Replayed records are dropped while the watermark still covers them."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def stream_windows(stream: DataFrame, event_time: str, delay: str, width: str, group: list[str], slide: str | None = None, session: bool = False) -> DataFrame:
    """Counts of event-time windows; records past the watermark are rejected.

    ``session``: windows end after ``width`` without a record.
    """
    span = F.session_window(event_time, width) if session else F.window(event_time, width, slide) if slide else F.window(event_time, width)
    counted = stream.withWatermark(event_time, delay).groupBy(span.alias("window"), *group).agg(F.count("*").alias("rows"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *group, "rows")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there and stop; a restart goes on from the checkpoint and repeats nothing."""
    if mode not in MODES:
        raise Blocked("FX-ARGUMENT", f"no output mode {mode}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").option("path", sink).start() if mode == "append" else writer.format("memory").queryName(sink).start()
    query.awaitTermination()
    return query


def maintain_state(stream: DataFrame, target: str, checkpoint: str, key: str = "key", op: str = "op", order: tuple[str, ...] = ("sequence",), compact_every: int = 16) -> StreamingQuery:
    """Keep the state table of a change stream under ``target``.

    A micro-batch writes its keys' last records as a delta of its own, so its cost follows
    the batch and a batch that is run again gives the same files. Every ``compact_every``-th
    batch merges deltas and the last version into a version, and drops what only older versions
    need. Removed keys are kept as markers, so a late record cannot bring them back.
    """
    columns = stream.columns

    def merge(batch: DataFrame, number: int) -> None:
        _last(check_ops(batch.select(*columns), op), key, order).write.mode("overwrite").parquet(f"{target}/delta={number}")
        if (number + 1) % compact_every == 0:
            spark = batch.sparkSession
            versions = [v for v in _numbers(spark, target, "version") if v < number]
            rows = _parts(spark, target, max(versions, default=-1), number)
            _last(rows.select(*columns), key, order).write.mode("overwrite").parquet(f"{target}/version={number}")
            # a reader may still hold the version before this one
            old = max(versions, default=-1)
            for kind, gone in (("delta", [d for d in _numbers(spark, target, "delta") if d <= old]), ("version", [v for v in versions if v < old])):
                for n in gone:
                    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{kind}={n}")
                    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _last(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*[F.col(key) if c == key else F.col(f"__last.{c}").alias(c) for c in rows.columns])


def _numbers(spark: SparkSession, target: str, kind: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def _parts(spark: SparkSession, target: str, version: int, newest: int) -> DataFrame:
    """The rows of a version and of the deltas after it."""
    deltas = [d for d in _numbers(spark, target, "delta") if version < d <= newest]
    paths = ([f"{target}/version={version}"] if version >= 0 else []) + [f"{target}/delta={d}" for d in deltas]
    return spark.read.parquet(*paths)


def read_state(spark: SparkSession, target: str, key: str = "key", op: str = "op", order: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """The rows that are not removed, of the newest version and the deltas after it."""
    version, deltas = max(_numbers(spark, target, "version"), default=-1), _numbers(spark, target, "delta")
    rows = _parts(spark, target, version, max(deltas, default=-1))
    return _last(rows, key, order).filter(F.col(op).isin(*SETS))
