from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomic.llm import ctw
from fathomic.llm.langid import held_out

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_base_score_equals_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    counts = collections.Counter(w for d, t in rows if not held[d] for w in words(t))
    ends = sum(not held[d] for d, _ in rows)
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    out = ctw.score(docs.select("doc_id", "text"), held_out("doc_id", 1)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for d, t in rows:
        own = [counts[w] for w in words(t)] + [ends]
        r = by[d]
        assert r["held_out"] == held[d]
        assert r["n_tokens"] == len(own)
        assert r["n_known"] == sum(c > 0 for c in own)
        assert r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in own), abs=1e-6)
    bits = -sum(r["score"] for r in out if r["held_out"]) / math.log10(2) / sum(r["n_bytes"] for r in out if r["held_out"])
    assert bits < 2.6


def reference_tree(texts, depth):
    """Sequence-free context-tree weighting by recursion over dictionaries, all contexts kept."""
    counts = collections.Counter()
    for t in texts:
        data = [255] * depth + list(t.encode()) + [255]
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                context = tuple(data[i - 1 - k] for k in range(d))
                for j in range(8):
                    counts[context, (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1] += 1

    def pair(context, node):
        return counts[context, node, 0], counts[context, node, 1]

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    children = collections.defaultdict(set)
    for context, _, _ in counts:
        if context:
            children[context[:-1]].add(context)

    def weighted(context, node):
        a, b = pair(context, node)
        own = estimate(a, b)
        if len(context) == depth:
            return own, 1.0
        below = sum(weighted(c, node)[0] for c in children[context] if sum(pair(c, node)))
        whole = np.logaddexp(own, below) - math.log(2)
        return whole, math.exp(own - math.log(2) - whole)

    def probability(context, symbol):
        total = 0.0
        for j in range(8):
            node, bit = (1 << j) | (symbol >> (8 - j)), (symbol >> (7 - j)) & 1
            p = None
            for d in range(depth, -1, -1):
                a, b = pair(context[:d], node)
                if p is None and not a + b:
                    continue
                likely = (b + 0.5) / (a + b + 1)
                if d == depth:
                    p = likely
                else:
                    w = weighted(context[:d], node)[1]
                    p = w * likely + (1 - w) * (0.5 if p is None else p)
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total

    return probability


def test_tree_equals_reference(spark):
    texts = ["abracadabra", "abcabcabd", "", "banana band"]
    depth = 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tree = ctw.train(df, "text", depth, 0.0)
    reference = reference_tree(texts, depth)
    for text in [*texts, "zebra", "cab nab"]:
        data = [255] * depth + list(text.encode()) + [255]
        buf = np.frombuffer(text.encode(), np.uint8)
        keys, at = ctw.runs(buf, np.array([0, len(buf)]), depth)
        assert list(at) == [0, len(buf) + 1]
        want = [reference(tuple(data[i - 1 : i - 1 - depth : -1]) if i > depth else tuple(data[depth - 1 :: -1][:depth]), data[i]) for i in range(depth, len(data))]
        assert tree.score(keys) == pytest.approx(want, abs=1e-6)


def test_pruned_tree_is_a_distribution(spark, docs):
    tree = ctw.train(docs.select("text"), "text", 3, 2.0**-8)
    assert all(len(d.contexts) <= 2**8 for d in tree.depths)
    for context in (b"the", b"\xff\xff\xff", b"zq\x01"):
        prefix = (context[2] << 16) | (context[1] << 8) | context[0]
        keys = np.array([(prefix << 8) | s for s in range(256)], np.int64)
        assert (10 ** tree.score(keys)).sum() == pytest.approx(1, abs=1e-6)


def test_rare_contexts_are_scored(spark):
    """No share of the corpus cuts contexts: the scores are those of the tree that keeps all of them."""
    texts = ["ab" * 60_000, "zq xv wz", "quiz jinx", "zq xv wz", "quiz zq", "", "\u00e9\u00e8 new"]
    rows = [(i, t, i > 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    tree = ctw.train(df.filter("not out"), "text", ctw.DEPTH, 0.0)
    got = {r["doc_id"]: r["score"] for r in ctw.score(df, F.col("out")).collect()}
    for i, t, _ in rows:
        buf = np.frombuffer(t.encode(), np.uint8)
        assert got[i] == pytest.approx(tree.score(ctw.runs(buf, np.array([0, len(buf)]), ctw.DEPTH)[0]).sum(), rel=1e-5)
    for depth in (0, 1, 2, 3):
        tree = ctw.train(df.filter("not out"), "text", depth, 0.0)
        for r in ctw.score(df, F.col("out"), depth=depth).collect():
            buf = np.frombuffer(texts[r["doc_id"]].encode(), np.uint8)
            assert r["score"] == pytest.approx(tree.score(ctw.runs(buf, np.array([0, len(buf)]), depth)[0]).sum(), rel=1e-5)


def test_awkward_rows(awkward, empty):
    out = ctw.score(awkward, held_out("doc_id", 1)).collect()
    assert len(out) == awkward.count()
    blank = [r for r in out if r["doc_id"] in (2, 3)]
    assert {r["n_tokens"] for r in blank} == {1}
    assert len({r["score"] for r in blank}) == 1
    assert ctw.score(empty, held_out("doc_id", 1)).collect() == []
    untrained = ctw.score(awkward, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in untrained)
    assert all(r["score"] == pytest.approx((r["n_bytes"] + 1) * 8 * math.log10(0.5)) for r in untrained)
