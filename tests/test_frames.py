"""Frames, sources and sinks, change streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fathomic import Blocked
from fathomic.operators import picking, quality, reshape, rolling
from fathomic.plans import rewrites
from fathomic.sources import lakes, sinks, sqlite_table
from fathomic.streaming import changes


def rows(frame):
    df = frame.df if hasattr(frame, "df") else frame
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def small(session):
    return session.from_rows([(1, "a", 5), (2, "b", None), (3, "a", 7), (4, None, 7)], "id:int64,label:utf8,amount:int64")


def test_formats_round_trip(session, small, tmp_path):
    for fmt in ("csv", "jsonl", "parquet", "orc", "arrow"):
        path = str(tmp_path / f"t.{fmt}")
        small.write(path)
        back = session.read(path).select("id", "label", "amount").sort("id")
        assert rows(back) == rows(small), fmt
        with pytest.raises(Blocked) as e:
            small.write(path)
        assert e.value.code == "FX-SINK-EXISTS"
        small.write(path, overwrite=True)


def test_blocked_sources(session, small, tmp_path):
    for path, code in (("x.avro", "FX-SOURCE-FORMAT"), ("x.xyz", "FX-SOURCE-FORMAT"), ("http://h/x.csv", "FX-SOURCE-REMOTE")):
        with pytest.raises(Blocked) as e:
            session.read(path)
        assert e.value.code == code
    nested = small.with_columns(l=F.array(F.lit(1)))
    with pytest.raises(Blocked) as e:
        nested.write_orc(str(tmp_path / "n.orc"))
    assert e.value.code == "FX-SINK-TYPE"
    nested.write_csv(str(tmp_path / "n.csv"))
    assert session.read(str(tmp_path / "n.csv")).df.first()["l"] == "[1]"


def test_parts_and_partitions(session, small, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    small.write(a)
    small.write(b)
    assert session.read_parts([a, b]).count() == 8
    with pytest.raises(Blocked) as e:
        session.read_parts([a, a])
    assert e.value.code == "FX-SOURCE-DUPLICATE"
    tree = str(tmp_path / "tree")
    small.df.write.partitionBy("label").parquet(tree)
    assert session.read_partitioned(tree, ["label"]).count() == 4
    with pytest.raises(Blocked):
        session.read_partitioned(tree, ["nothing"])


def test_fanout_leaves_nothing_on_failure(session, small, tmp_path):
    good, bad = str(tmp_path / "g.parquet"), str(tmp_path / "missing" / "x.arrow")
    with pytest.raises(Exception):  # noqa: B017
        small.fanout({good: None, bad: None})
    assert list(tmp_path.iterdir()) == []
    small.fanout({good: None, str(tmp_path / "h.jsonl"): None})
    assert session.read(good).count() == session.read(str(tmp_path / "h.jsonl")).count() == 4
    assert sinks.write_native(small.df, str(tmp_path / "n.parquet")) == 4


def test_prepare_is_reused(session, small, tmp_path):
    src, target = str(tmp_path / "s.csv"), str(tmp_path / "prepared")
    small.write_csv(src)
    one = session.prepare(src, target, derived=True)
    two = session.prepare(src, target, derived=True)
    assert one.df.inputFiles() == two.df.inputFiles()
    assert "__len_label" in one.columns
    assert one.select("*").columns == ["id", "label", "amount"]


def test_sqlite_round_trip(session, small, tmp_path):
    path = str(tmp_path / "t.db")
    assert sqlite_table.write(small.df, path, "t") == 4
    assert rows(session.read_sqlite(path, "t").sort("id")) == rows(small)
    with pytest.raises(Blocked):
        sqlite_table.write(small.df, path, "t")
    with pytest.raises(Blocked):
        session.read_sqlite(path, "other")


def test_delta_log_replay(session, small, tmp_path):
    log = tmp_path / "d" / "_delta_log"
    log.mkdir(parents=True)
    for k in (1, 2, 3):
        small.filter(F.col("id") == k).df.coalesce(1).write.parquet(str(tmp_path / "d" / f"p{k}"))
    (log / f"{0:020d}.json").write_text("\n".join(json.dumps({"add": {"path": f"p{k}"}}) for k in (1, 2)))
    (log / f"{1:020d}.json").write_text("\n".join([json.dumps({"remove": {"path": "p1"}}), json.dumps({"add": {"path": "p3"}})]))
    assert sorted(r[0] for r in rows(session.read_delta(str(tmp_path / "d")))) == [2, 3]
    assert sorted(r[0] for r in rows(session.read_delta(str(tmp_path / "d"), 0))) == [1, 2]
    with pytest.raises(Blocked):
        session.read_delta(str(tmp_path / "d"), 7)


def test_iceberg_snapshots(session, small, tmp_path):
    meta = tmp_path / "i" / "metadata"
    meta.mkdir(parents=True)
    for k in (1, 2):
        small.filter(F.col("id") == k).df.write.parquet(str(tmp_path / "i" / f"p{k}"))
    (meta / "m1.json").write_text(json.dumps([{"file_path": "p1"}]))
    (meta / "m2.json").write_text(json.dumps([{"file_path": "p1"}, {"file_path": "p2"}]))
    (meta / "v1.metadata.json").write_text(json.dumps({"current-snapshot-id": 2, "snapshots": [{"snapshot-id": 1, "timestamp-ms": 10, "manifest-list": "m1.json"}, {"snapshot-id": 2, "timestamp-ms": 20, "manifest-list": "m2.json"}]}))
    path = str(tmp_path / "i")
    assert session.read_iceberg(path).count() == 2
    assert session.read_iceberg(path, snapshot_id=1).count() == 1
    assert session.read_iceberg(path, as_of_ms=15).count() == 1
    with pytest.raises(Blocked):
        session.read_iceberg(path, as_of_ms=5)
    (tmp_path / "i" / ".hoodie").mkdir()
    (tmp_path / "i" / ".hoodie" / "20240101.commit").write_text("")
    (tmp_path / "i" / ".hoodie" / "20240102.commit.inflight").write_text("")
    assert lakes.hudi_timeline(session.spark, path) == [("20240101", "commit", "completed"), ("20240102", "commit", "inflight")]


def test_manifest_commits(spark, small, tmp_path):
    t = lakes.ManifestTable(spark, str(tmp_path / "m"))
    assert t.append(small.df) == 1
    assert t.append(small.df, expected=1) == 2
    with pytest.raises(Blocked) as e:
        t.append(small.df, expected=1)
    assert e.value.code == "FX-COMMIT"
    small.df.write.parquet(str(tmp_path / "m" / "data" / "part-orphan"))
    assert t.recover() == ["part-orphan"]
    assert t.read().count() == 8
    assert t.read(1).count() == 4
    deleted = small.df.filter("id = 1")
    assert lakes.subtract_deleted(t.read(1), deleted, ["id"]).count() == 3
    assert lakes.overlay(small.df, deleted).count() == 5


def test_generated(session):
    assert rows(session.range(2, 8, 3)) == [(2,), (5,)]
    with pytest.raises(Blocked):
        session.range(0, 5, 0)
    with pytest.raises(Blocked):
        session.calendar("2024-02-01", "2024-01-01")
    with pytest.raises(Blocked):
        session.from_rows([(1,)], "a:int64,b:int64")


def test_projection_family(session, small):
    f = small.rename({"amount": "n"}).astype({"n": "float64"}).drop("label")
    assert f.columns == ["id", "n"]
    with pytest.raises(Blocked):
        small.select("nothing")
    assert rows(small.arithmetic("amount", "/", 2).select("amount")) == [(2,), (None,), (3,), (3,)]
    assert rows(small.str_replace("label", "a", "z").select("label")) == [("z",), ("b",), ("z",), (None,)]
    assert rows(small.isna("label")) == [(False,), (False,), (False,), (True,)]
    with pytest.raises(Blocked):
        small.map("id", lambda c: 1)
    assert small.pipe(lambda f: f.limit(2)).collect().evidence["row_count"] == 2
    assert rows(small.replace("a", "q").select("label"))[0] == ("q",)


def test_joins(session, small):
    other = session.from_rows([(1, "x"), (9, "y")], "id:int64,label:utf8")
    assert rows(small.join(other, "id")) == [(1, "a", 5, "x")]
    assert small.join(other, "id", "left").count() == 4
    assert small.join(other, "id", "full").count() == 5
    assert small.join(other, "id", "anti").columns == small.columns
    assert small.join(other, how="cross").count() == 8
    nested = small.with_columns(k=F.array("id"))
    with pytest.raises(Blocked):
        nested.join(nested, "k")
    with pytest.raises(Blocked):
        small.union(other)


def test_picking(session, small):
    assert [r[0] for r in rows(small.tail(2))] == [3, 4]
    assert [r[0] for r in rows(small.nlargest(1, "amount", keep="all").sort("id"))] == [3, 4]
    assert [r[0] for r in rows(small.nlargest(1, "amount", keep="last", order=["id"]))] == [4]
    drawn = small.sample(n=2, seed=3, key=["id"])
    assert rows(drawn) == rows(small.sample(n=2, seed=3, key=["id"]))
    assert drawn.count() == 2
    assert small.sample(n=9, seed=1, replace=True).count() == 9
    weighted = picking.sample(small.df.fillna(0), n=4, seed=1, weights="amount", key=["id"])
    assert 2 not in [r[0] for r in rows(weighted)]
    with pytest.raises(Blocked):
        small.sample()


def test_duplicates(session, small):
    by = ["label"]
    assert sorted(r[0] for r in rows(small.drop_duplicates(by, "first", ["id"]))) == [1, 2, 4]
    assert sorted(r[0] for r in rows(small.drop_duplicates(by, "last", ["id"]))) == [2, 3, 4]
    assert sorted(r[0] for r in rows(small.drop_duplicates(by, False))) == [2, 4]
    assert [r[-1] for r in rows(small.duplicated(by, False, ["id"]).sort("id"))] == [True, False, True, False]


def test_rolling_over_blocks_equals_one_window(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 17).alias("v"))
    got = rolling.rolling(df, "v", "sum", 5, 2, center=True, order=["id"], name="s")
    pdf = df.orderBy("id").toPandas()
    want = pdf["v"].rolling(5, min_periods=2, center=True).sum()
    have = got.orderBy("id").toPandas()["s"]
    assert (have.fillna(-1).tolist()) == (want.fillna(-1).tolist())
    filled = rolling.ffill(df.filter("id > 0").select("id", F.when(F.col("id") % 9_000 == 0, F.col("id")).alias("v")), "v", order=["id"]).orderBy("id").toPandas()["v"]
    assert filled.isna().sum() == 8_999
    assert filled.iloc[-1] == 18_000


def test_reshape(session, small):
    out = reshape.explode(session.spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, None, None), (3, [], [])], "id int, x array<int>, y array<string>"), ["x", "y"])
    assert sorted(rows(out), key=str) == sorted([(1, 1, "a"), (1, 2, "b"), (2, None, None), (3, None, None)], key=str)
    uneven = session.spark.createDataFrame([(1, [1, 2], ["a"])], "id int, x array<int>, y array<string>")
    with pytest.raises(Exception, match="differ in size"):
        reshape.explode(uneven, ["x", "y"]).collect()
    twice = session.from_rows([(1, "a", 1), (1, "a", 2)], "k:int64,c:utf8,v:int64")
    with pytest.raises(Exception, match="one cell"):
        twice.pivot(["k"], "c", "v").df.collect()
    table = small.pivot_table(["label"], "id", "amount", "sum", names=[1, 3], fill_value=0, margins=True)
    assert ("a", 5, 7, 12) in rows(table)
    structs = session.spark.createDataFrame([(1, [(1, "x")])], "id int, items array<struct<n:int,s:string>>")
    assert reshape.explode_fields(structs, "items", ["n"]).columns == ["id", "items.n"]


def test_quality(session, small):
    found = {r["column"]: r for r in quality.profile(small.df).collect()}
    assert found["amount"]["nulls"] == 1
    assert found["amount"]["max"] == "7"
    assert small.validate_schema("id bigint, label int, extra string") == ["missing column extra", "column label is string, not int", "unexpected column amount"]
    holds = {r["rule"]: r["holds"] for r in small.data_quality(not_null=["id", "label"], unique=["id"], between={"amount": (0, 6)}).df.collect()}
    assert holds == {"not_null(id)": True, "not_null(label)": False, "unique(id)": True, "between(amount)": False}
    old, new = small.select("id", "label").schema, session.from_rows([], "label:utf8,id:float64,z:int64").schema
    assert ("add", "z") in quality.schema_changes(old, new)


def test_rewrites(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 5)], "k bigint, v bigint")
    assert sorted(rows(rewrites.sums_with_offsets(df, "v", [0, 3], by=["k"]))) == [(1, 2, 5), (2, 5, 8)]
    assert sorted(rows(rewrites.group_with_offsets(df, "k", {"k1": -1}, [F.count("*").alias("n")]))) == [(1, 0, 2), (2, 1, 1)]
    with pytest.raises(Blocked):
        rewrites.sums_with_offsets(df.withColumn("v", F.lit(1.5)), "v", [1])


RECORDS = [
    ("a", "append", 1, 100), ("b", "append", 2, 110), ("c", "append", 3, 120), ("a", "upsert", 4, 130), ("c", "delete", 5, 140),
    ("d", "append", 6, 90), ("d", "tombstone", 7, 150), ("e", "upsert", 8, 160), ("f", "append", 9, 105), ("f", "retract", 10, 170),
]


def stream_rows(spark):
    return spark.createDataFrame(RECORDS, "key string, op string, sequence bigint, event_time bigint").withColumn("offset", F.col("sequence"))


def test_change_streams(spark):
    df = stream_rows(spark)
    assert sorted(r["key"] for r in changes.state(df).collect()) == ["a", "b", "e"]
    assert changes.replay_dedup(df.union(df)).count() == 10
    counted = changes.late_count(df, "event_time", ["sequence"]).first()
    assert (counted["late"], counted["records"], counted["watermark"]) == (2, 10, 170)
    base = spark.createDataFrame([("a", 0, 1), ("c", 0, 1), ("z", 0, 1)], "key string, sequence bigint, event_time bigint")
    merged = {r["key"]: r["sequence"] for r in changes.hybrid(base, df).collect()}
    assert merged == {"a": 4, "b": 2, "e": 8, "z": 0}
    counts = changes.hybrid_counts(base, df).first()
    assert (counts["removed"], counts["replaced"], counts["kept"], counts["added"]) == (1, 1, 1, 2)
    with pytest.raises(Exception, match="unknown operation"):
        changes.state(df.withColumn("op", F.lit("other"))).collect()


def test_structured_streaming(spark, tmp_path):
    source, target, point = (str(tmp_path / n) for n in ("in", "state", "point"))
    df = stream_rows(spark)
    df.filter("sequence <= 5").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    changes.maintain_state(stream, target, point)
    assert sorted(r["key"] for r in changes.read_state(spark, target).collect()) == ["a", "b"]
    df.filter("sequence > 5").coalesce(1).write.mode("append").parquet(source)
    changes.maintain_state(spark.readStream.schema(df.schema).parquet(source), target, point)
    assert sorted(r["key"] for r in changes.read_state(spark, target).collect()) == ["a", "b", "e"]
    counted = changes.stream_counts(spark.readStream.schema(df.schema).parquet(source), ["op"])
    changes.run_to_end(counted, "op_counts", str(tmp_path / "point2"), "complete")
    assert {r["op"]: r["rows"] for r in spark.table("op_counts").collect()}["append"] == 5
    kept = changes.stream_dedup(spark.readStream.schema(df.schema).parquet(source).withColumn("t", F.timestamp_seconds("event_time")), "t", "1 hour", ["offset", "sequence"])
    changes.run_to_end(kept, str(tmp_path / "out"), str(tmp_path / "point3"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_capabilities_and_vectors(session):
    from fathomic.operators import vectors

    assert session.capabilities()["functions"]["python_udf"].startswith("blocked")
    df = session.spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "id bigint, v array<double>")
    assert [r["id"] for r in vectors.nearest(df, "v", [0.0, 0.9], "id", 2).collect()] == [1, 2]
    text = session.spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r[1] for r in vectors.embed_text(text, "t").collect()] == [[2.0, 195.0, 1.0, float(vectors.fnv64(b"ab") % 10_000)], None]
