"""Partition transforms, byte ranges, layout and sketches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomic import Blocked, queries
from fathomic.operators import sketches
from fathomic.sources import partitioning as part


def test_transforms(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '1971-03-02 05:06:07' AS t, 'abcdef' AS s, CAST(-7 AS BIGINT) AS n")
    one = df.select(*[part.transform("t", k).alias(k) for k in ("year", "month", "day", "hour")], part.transform("s", "truncate", 3).alias("s"), part.transform("n", "truncate", 5).alias("n"), part.transform("n", "bucket", 4).alias("b")).first()
    assert tuple(one)[:6] == (1, 14, 425, 425 * 24 + 5, "abc", "-10")
    assert 0 <= one["b"] < 4
    for kind, width in (("week", None), ("bucket", None), ("truncate", 0)):
        with pytest.raises(Blocked):
            part.transform("n", kind, width)


def test_partitioned_layout(spark, session, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(100).withColumn("s", F.lit("x"))
    part.write_partitioned(df, path, {"b": ("id", "bucket", 4)})
    back = session.read_partitioned(path, ["b"])
    assert back.count() == 100
    health = part.layout_health(spark.read.parquet(path)).first()
    assert health["rows"] == 100
    assert health["files"] == health["small_files"] == 4
    assert {r["output"] for r in part.compaction_plan(spark.read.parquet(path)).collect()} == {0}


def test_byte_ranges(spark, tmp_path):
    (tmp_path / "o").write_bytes(b"0123456789")
    assert part.read_range(spark, str(tmp_path / "o"), 3, 4) == b"3456"
    with pytest.raises(Blocked):
        part.read_range(spark, str(tmp_path / "o"), 8, 4)


def test_sketches_merge(spark):
    df = spark.range(2000).select((F.col("id") % 500).alias("v"), (F.col("id") % 3).alias("g"))
    whole = sketches.estimate(sketches.merge(sketches.build(df, "v", ["g"]))).first()["approx_distinct"]
    assert abs(whole - 500) < 15
    assert abs(sketches.approx_count_distinct(df, "v").first()[0] - 500) < 30


def test_a_sketch_beside_the_exact_count_is_one_for_the_table(spark, sf):
    df = spark.range(2000).select((F.col("id") % 500).alias("v"))
    both = sketches.beside_exact(df, "v")
    assert both.first()["distinct"] == 500
    assert abs(both.first()["approx_distinct"] - 500) < 30
    for own in (both, queries.sketch_bounds(spark, sf)):
        plan = own._jdf.queryExecution().executedPlan().toString()
        grouped = [line for line in plan.splitlines() if "Aggregate(keys=[" in line and "keys=[]" not in line]
        assert grouped
        assert not any("approx_count_distinct" in line for line in grouped)


def _delta(spark, root, commits, checkpoint=None):
    import json

    log = root / "_delta_log"
    log.mkdir(parents=True, exist_ok=True)
    for v, actions in commits.items():
        (log / f"{v:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    if checkpoint:
        version, adds = checkpoint
        rows = [({"path": p, "partitionValues": {}},) for p in adds]
        spark.createDataFrame(rows, "add struct<path: string, partitionValues: map<string, string>>").coalesce(1).write.parquet(str(root / "cp"))
        next((root / "cp").glob("*.parquet")).rename(log / f"{version:020d}.checkpoint.parquet")


def test_delta_checkpoints_replace_older_commits(spark, session, tmp_path):
    for k in (1, 2, 3):
        spark.range(k).write.parquet(str(tmp_path / f"p{k}"))
    _delta(spark, tmp_path, {11: [{"add": {"path": "p3"}}, {"remove": {"path": "p1"}}]}, (10, ["p1", "p2"]))
    assert session.read_delta(str(tmp_path)).count() == 5
    assert session.read_delta(str(tmp_path), 10).count() == 3
    _delta(spark, tmp_path, {13: [{"add": {"path": "p1"}}]})
    with pytest.raises(Blocked):
        session.read_delta(str(tmp_path))


def test_delta_partition_values_and_what_is_not_read(spark, session, tmp_path):
    import json

    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a b"))
    name = next((tmp_path / "a b").glob("*.parquet")).name
    meta = {"metaData": {"partitionColumns": ["k"], "schemaString": json.dumps({"type": "struct", "fields": [{"name": "id", "type": "long"}, {"name": "k", "type": "integer"}]})}}
    _delta(spark, tmp_path, {0: [meta, {"add": {"path": f"a%20b/{name}", "partitionValues": {"k": "7"}}}]})
    got = session.read_delta(str(tmp_path)).df
    assert got.dtypes == [("id", "bigint"), ("k", "int")]
    assert {tuple(r) for r in got.collect()} == {(0, 7), (1, 7), (2, 7)}
    for bad in ({"add": {"path": "x", "deletionVector": {"storageType": "u"}}}, {"metaData": {"configuration": {"delta.columnMapping.mode": "name"}}}):
        _delta(spark, tmp_path, {1: [bad]})
        with pytest.raises(Blocked):
            session.read_delta(str(tmp_path))


def test_iceberg_delete_files_are_refused(session, spark, tmp_path):
    import json

    meta = tmp_path / "metadata"
    meta.mkdir()
    spark.range(2).write.parquet(str(tmp_path / "p1"))
    (meta / "m1.json").write_text(json.dumps([{"file_path": "p1"}, {"file_path": "d1", "content": 1}]))
    (meta / "v1.metadata.json").write_text(json.dumps({"current-snapshot-id": 1, "snapshots": [{"snapshot-id": 1, "timestamp-ms": 1, "manifest-list": "m1.json"}]}))
    with pytest.raises(Blocked):
        session.read_iceberg(str(tmp_path))


def test_a_failed_overwrite_keeps_what_was_there(session, spark, tmp_path, monkeypatch):
    from fathomic.sources import sinks

    one, two = str(tmp_path / "one.parquet"), str(tmp_path / "two.parquet")
    sinks.fanout(spark.range(3), {one: None, two: None})
    real = sinks.exists
    monkeypatch.setattr(sinks, "exists", lambda s, p: (_ for _ in ()).throw(OSError("lost")) if p == two and list(tmp_path.glob("one.parquet.replaced-*")) else real(s, p))
    with pytest.raises(OSError, match="lost"):
        sinks.fanout(spark.range(9), {one: None, two: None}, overwrite=True)
    assert session.read(one).count() == session.read(two).count() == 3
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one.parquet", "two.parquet"]
    monkeypatch.undo()
    sinks.fanout(spark.range(9), {one: None, two: None}, overwrite=True)
    assert session.read(one).count() == session.read(two).count() == 9


def test_writers_neither_overwrite_nor_clean_each_other(spark, tmp_path, monkeypatch):
    from fathomic.sources import lakes

    t = lakes.ManifestTable(spark, str(tmp_path / "m"))
    t.append(spark.range(1))
    late = lakes.ManifestTable(spark, str(tmp_path / "m"))
    monkeypatch.setattr(late, "version", lambda: 0)
    with pytest.raises(Blocked):
        late.append(spark.range(5))
    assert t.read().count() == 1
    # the writer that lost still holds its lease: an hour has to pass
    assert t.recover() == []
    assert len(t.recover(lease_seconds=0)) == 1
    assert t.append(spark.range(2)) == 2
    assert t.read().count() == 3


def test_arrow_files_stream(spark, session, tmp_path):
    path = str(tmp_path / "x.arrow")
    session.frame(spark.range(20_000).withColumn("t", F.concat(F.lit("r"), "id")).repartition(3)).write_arrow(path)
    back = session.read(path).df
    assert back.count() == 20_000
    assert back.filter("t = concat('r', id)").count() == 20_000


def test_joins_and_lists_lose_the_bound(session, spark):
    few, many = session.frame(spark.range(5)).limit(2), session.frame(spark.range(50))
    assert few.join(many, how="cross").bounded is False
    assert few.join(many, "id").bounded is False
    assert few.join(many, "id", "semi").bounded is True
    assert few.join(many.limit(3), "id").bounded is True
    assert "BroadcastHashJoin" in many.join(few, "id", hint="broadcast").df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in many.join(few, "id", hint="merge").df._jdf.queryExecution().executedPlan().toString()
    for bad in ("broadcast", "nothing"):
        with pytest.raises(Blocked):
            few.join(many, "id", hint=bad)
    assert session.frame(spark.sql("SELECT array(1, 2) AS a")).limit(1).explode("a").bounded is False


def test_weighted_draws_with_replacement(spark):
    from fathomic.operators import picking

    df = spark.range(10).withColumn("w", F.when(F.col("id") == 3, 6.0).when(F.col("id") == 5, 3.0).when(F.col("id") == 7, 1.0).otherwise(0.0))
    got = {r["id"]: r["count"] for r in picking.sample(df, n=10_000, seed=1, weights="w", replace=True).groupBy("id").count().collect()}
    assert set(got) == {3, 5, 7}
    assert sum(got.values()) == 10_000
    assert abs(got[3] - 6000) < 300
    assert abs(got[7] - 1000) < 200


def test_fnv_of_many_texts():
    from fathomic.operators.vectors import fnv64_all

    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h

    texts = [b"", b"a", b"foobar", "é🎉".encode() * 9, b"a" * 300]
    assert fnv64_all(texts).tolist() == [plain(t) for t in texts]
    assert fnv64_all([]).tolist() == []


def test_state_is_kept_by_deltas_and_versions(spark, tmp_path):
    from fathomic.streaming import changes

    source, target, point = (str(tmp_path / x) for x in ("in", "state", "point"))
    schema = "key string, op string, value long, sequence long"
    want = {}
    known = [x for x in (*changes.SETS, *changes.REMOVES)]
    for k in range(7):
        rows = [(f"k{(k * 3 + j) % 5}", known[(k + j) % len(known)], 10 * k + j, 10 * k + j) for j in range(3)]
        for key, op, value, _ in rows:
            want[key] = value if op in changes.SETS else None
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes.maintain_state(spark.readStream.schema(schema).parquet(source), target, point, compact_every=3)
        got = {r["key"]: r["value"] for r in changes.read_state(spark, target).collect()}
        assert got == {a: b for a, b in want.items() if b is not None}
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["delta=3", "delta=4", "delta=5", "delta=6", "version=2", "version=5"]


def test_objects_commit_with_a_record(spark, tmp_path):
    path = str(tmp_path / "o.bin")
    assert part.recover_object(spark, path) == "absent"
    part.write_object(spark, path, b"abc")
    part.write_object(spark, path, b"abcd")
    assert part.recover_object(spark, path) == "committed"
    (tmp_path / "o.bin.commit.json").unlink()
    assert part.recover_object(spark, path) == "finished"
    (tmp_path / "p.bin.staged").write_bytes(b"half")
    assert part.recover_object(spark, str(tmp_path / "p.bin")) == "rolled_back"
    (tmp_path / ".o.bin.crc").unlink(missing_ok=True)
    (tmp_path / "o.bin").write_bytes(b"wxyz")
    with pytest.raises(Blocked):
        part.recover_object(spark, path)


def test_row_events_of_a_feed(spark):
    from fathomic.streaming import changes

    df = spark.createDataFrame([("a", "Insert"), ("a", "metadata"), ("b", "u"), ("c", "tombstone"), ("d", "schema")], "key string, op string")
    assert sorted((r["key"], r["op"]) for r in changes.row_events(df).collect()) == [("a", "append"), ("b", "upsert"), ("c", "tombstone")]
    with pytest.raises(Exception, match="unknown operation"):
        changes.row_events(df.withColumn("op", F.lit("?"))).collect()
