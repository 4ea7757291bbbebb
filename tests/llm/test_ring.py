from __future__ import annotations

import collections
import zlib

from pyspark.sql import functions as F

import pytest

from fathomic.llm import ring


def check(df, shards=8):
    out = ring.shard(df, shards).collect()
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == want
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return out


def test_documents(docs):
    out = check(docs)
    loads = collections.Counter()
    for r in out:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 8
    mean = sum(loads.values()) / 8
    assert max(loads.values()) <= max(1.05 * mean, mean + max(r["size"] for r in out))
    where = collections.defaultdict(set)
    for r in out:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_a_group_of_a_third_of_all_rows_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 40)).otherwise(F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 30))).alias("text"))
    loads = collections.Counter()
    for r in check(df):
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.05 * sum(loads.values()) / 8


def brute(loads, shards):
    """The walk told plainly: one key after the other, clockwise to the first shard with room."""
    points = ring.ring_points(shards)
    cap = (1 + ring.SLACK) * sum(loads.values()) / shards
    held, out = [0] * shards, {}
    for cell, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        place = cell << (64 - ring.CELL_BITS)
        order = [s for p, s in points if p >= place] + [s for p, s in points if p < place]
        room = [s for s in order if held[s] + load <= cap]
        s = room[0] if room else min(range(shards), key=lambda x: (held[x], x))
        held[s] += load
        out[cell] = s
    return out


def test_walk_equals_brute_force_and_moves_little():
    import random

    rng = random.Random(1)
    loads = {c: rng.randrange(1, 50) for c in rng.sample(range(1 << ring.CELL_BITS), 2000)}
    eight = ring.walk(loads, 8)
    assert eight == brute(loads, 8)
    nine = ring.walk(loads, 9)
    moved = sum(loads[c] for c in loads if eight[c] != nine[c]) / sum(loads.values())
    assert moved < 0.16


def test_awkward_rows(awkward, empty):
    check(awkward)
    assert ring.shard(empty, 8).collect() == []


@pytest.mark.parametrize("ids", [None, 7])
def test_a_heavy_group_of_equal_rows_is_spread(spark, ids):
    rows = [(ids, "x" * 1000)] * 900 + [(k, f"text {k} " * 10) for k in range(400)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    loads = collections.Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.02 * sum(loads.values()) / 8
