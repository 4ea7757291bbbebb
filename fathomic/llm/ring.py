"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Rows hash to one of ``2**cell_bits`` equal cells of a ring; every shard stands on the
ring as ``virtual`` points. A cell belongs to the first point clockwise, unless that
point's shard would pass its capacity: then the cell continues clockwise to the next
shard with room. Capacity is ``(1 + slack)`` times the mean load, so the balance holds by
construction, and another shard count moves few cells beside those it must.

Law ``bytes``: a load is the sum of sizes. Equal texts share a cell and so a shard,
except a group of copies heavier than one shard's fair share: its rows are salted one by
one over the whole ring, whatever their ids. Only the cells' loads, at most ``2**cell_bits`` numbers,
reach the driver; a table of as many cells goes back to the rows.

Defined results: null text counts as size 1 and shares a group with nothing but other
nulls; an empty table gives an empty result; rows with equal ids are rows of their own.
"""

from __future__ import annotations

from bisect import bisect_right
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fathomic.llm._spark import durable

CELL_BITS = 16
VIRTUAL = 128
SLACK = 0.002


def ring_points(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """Sorted (place, shard) of every virtual node; a shard's points don't depend on the shard count."""
    return sorted((int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(virtual))


def walk(loads: dict[int, int], shards: int, cell_bits: int = CELL_BITS, virtual: int = VIRTUAL, slack: float = SLACK) -> dict[int, int]:
    """The shard of each cell under bounded loads.

    Heavy cells go first, so light ones fill what is left. A cell that no shard has
    room for goes to the least loaded shard.
    """
    points = ring_points(shards, virtual)
    places = [p for p, _ in points]
    capacity = (1 + slack) * sum(loads.values()) / shards
    held = [0] * shards
    out: dict[int, int] = {}
    for cell, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        start = bisect_right(places, (cell << (64 - cell_bits)) - 1)
        tried: list[int] = []
        for k in range(len(points)):
            s = points[(start + k) % len(points)][1]
            if s not in tried:
                if held[s] + load <= capacity:
                    break
                tried.append(s)
                if len(tried) == shards:
                    s = min(range(shards), key=lambda x: (held[x], x))
                    break
        held[s] += load
        out[cell] = s
    return out


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", cell_bits: int = CELL_BITS, virtual: int = VIRTUAL, slack: float = SLACK) -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``slot`` numbers a shard's rows from 0 without gaps: rows are numbered within
    many small parts of a shard, and each part starts where the one before ends.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    rows = durable(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text, F.isnull(text)).alias("group"),
            # written with the rows, so that it tells equal rows apart in every later pass
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    fair = (total["bytes"] or 0) / shards
    parts = min(1 << 16, max(64, -(-total["n"] // (shards << 16))))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # at most ``shards`` groups can be heavier than a fair share
    split = [r["group"] for r in groups.filter((F.col("bytes") > fair) & (F.col("n") > 1)).select("group").collect()]
    key = F.when(F.col("group").isin(split), F.xxhash64("group", "row")).otherwise(F.col("group")) if split else F.col("group")
    rows = rows.withColumn("cell", F.shiftrightunsigned(F.xxhash64(key, F.lit("ring")), 64 - cell_bits).cast("int"))
    loads = {r["cell"]: r["load"] for r in rows.groupBy("cell").agg(F.sum("size").alias("load")).collect()}
    placed = walk(loads, shards, cell_bits, virtual, slack)
    table = spark.createDataFrame(sorted(placed.items()), "cell int, shard int")
    part = F.pmod(F.xxhash64("row", F.lit("part")), F.lit(parts)).cast("int")
    rows = rows.join(F.broadcast(table), "cell").withColumn("part", part)
    counts = rows.groupBy("shard", "part").count().collect()
    starts, at = [], {}
    for s, p, n in sorted((r["shard"], r["part"], r["count"]) for r in counts):
        starts.append((s, p, at.get(s, 0)))
        at[s] = at.get(s, 0) + n
    begins = spark.createDataFrame(starts, "shard int, part int, begin long")
    order = W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size", "group", "row")
    return (
        rows.join(F.broadcast(begins), ["shard", "part"])
        .withColumn("slot", F.col("begin") + F.row_number().over(order) - 1)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
