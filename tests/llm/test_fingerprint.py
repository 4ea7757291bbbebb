from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from fathomic.llm import fingerprint as fp


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    for i, (doc, text, *_) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        yield doc, len(text), hashlib.sha256((text[: len(text) - k] + following[:k]).encode()).hexdigest()


def test_edits_and_likeness(spark, docs):
    out = fp.edited_fingerprints(docs).collect()
    want = {d: (n, h) for d, n, h in brute([(r["doc_id"], r["text"] or "") for r in docs.collect()])}
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in out} == want
    long = [r for r in out if r["n_chars"] > 300]
    near = sorted(r["near_edited"] for r in long)
    assert near[len(near) // 20] > 0.4
    assert 0.6 < sum(near) / len(near) < 0.9
    assert sum(r["near_next"] for r in long) / len(long) < 0.15
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_text = {}
    for r in out:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)


def test_paragraphs_are_a_multiset():
    a, b = fp.vectors([b"one two\nthree\nthree", b"three\none two\nthree"])
    assert fp.encode(a) == fp.encode(b)
    base = fp.encode(fp.vectors([b"one two\nthree"])[0])
    assert fp.add(base, "three") == fp.encode(a)
    assert fp.remove(fp.encode(a), "three") == base
    assert fp.encode(fp.vectors([b"one two\nthree\nfour"])[0]) != fp.encode(a)


def test_awkward_rows(spark, awkward, empty):
    out = fp.edited_fingerprints(awkward).collect()
    assert len(out) == awkward.count()
    assert sum(r["doc_id"] is None for r in out) == 1
    blank = [r for r in out if r["doc_id"] in (2, 3)]
    assert len({r["fingerprint"] for r in blank}) == 1
    assert all(r["n_chars"] == 0 for r in blank)
    assert fp.edited_fingerprints(empty).collect() == []
    one = fp.edited_fingerprints(awkward.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0
    assert fp.fingerprints(awkward).count() == awkward.count()


def test_no_task_boundary_is_visible(spark, docs):
    wide = spark.conf.get("spark.sql.shuffle.partitions")
    one = {r["doc_id"]: tuple(r) for r in fp.edited_fingerprints(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = {r["doc_id"]: tuple(r) for r in fp.edited_fingerprints(docs.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)
    assert one == many


@pytest.mark.parametrize("ids", [None, 7])
def test_a_hot_id_is_cut_into_many_buckets(spark, ids):
    """Rows of one id, most of them equal, fall into many buckets and keep their order by text."""
    rows = [(ids, "same text")] * 300 + [(ids, f"text {k:03}") for k in range(300)] + [(k, f"own {k}") for k in range(100, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = fp.edited_fingerprints(df).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = []
    for k, (i, text) in enumerate(order):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + order[(k + 1) % len(order)][1][:cut]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=str) == sorted(want, key=str)
    tied = df.withColumn("tie", F.struct(F.sha2("text", 256).alias("a"), F.monotonically_increasing_id().alias("n")))
    sizes = [r["count"] for r in tied.groupBy(fp._tied_bucket(tied, 16, len(rows)).alias("b")).count().collect()]
    assert len(sizes) > 12
    assert max(sizes) < 100
