from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pytest

from fathomic.llm import partenum as pe

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, num, den):
    """Least reachable id of each row, by all pairs that share a shingle."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    shared = collections.Counter((a, b) for own in where.values() for k, b in enumerate(own) for a in own[:k])
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in pe.join(df, **options).collect()), key=str)


def test_documents_equal_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, width=4, num=85, den=100) == brute(rows, 4, 85, 100)


def test_chains_of_near_copies(spark):
    """Edited copies, copies of copies, and sizes at the bounds of the bands."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 35, 60, 110, 300):
        for _ in range(4):
            text = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(12):
                rows.append((len(rows), " ".join(text)))
                for _ in range(rng.choice((0, 1, 1, max(1, size // 60), max(1, size // 30)))):
                    k = rng.randrange(len(text))
                    if rng.random() < 0.3 and len(text) > 1:
                        del text[k]
                    else:
                        text[k] = rng.choice(vocabulary)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, num, den in ((4, 85, 100), (1, 80, 100), (2, 60, 100)):
        assert found(df, width=width, num=num, den=den) == brute(rows, width, num, den), (width, num)


@pytest.mark.parametrize(("block", "many"), [(1024, 16), (16, 16), (16, 2)])
def test_large_families(spark, monkeypatch, block, many):
    """Stars above the size that is compared at once, in blocks and split by a second partitioning."""
    monkeypatch.setattr(pe, "_BLOCK", block)
    monkeypatch.setattr(pe, "_MANY", many)
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(5000)]
    rows = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(130)]
        for _ in range(150):
            text = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 7))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = text
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 85, 100)
    assert len({c for _, _, c in want}) > 3
    assert found(df, width=4, num=85, den=100) == want


def made(spark, job):
    """Rows that inner joins by node make in ``job``."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows, executions = 0, store.executionsList()
    for k in range(before, executions.size()):
        run = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if re.search(r"Join \[node#\w+\], \[node#\w+\], Inner", node.desc()):
                metrics = node.metrics()
                for m in (metrics.apply(i) for i in range(metrics.size())):
                    if m.name() == "number of output rows" and (value := values.get(m.accumulatorId())).isDefined():
                        rows += int(value.get().replace(",", ""))
    return rows


def test_facts_join_each_place_in_a_star_once(spark, monkeypatch):
    """A family of near copies in stars of several blocks: sizes and profiles come once, not for each step and unit."""
    monkeypatch.setattr(pe, "_BLOCK", 64)
    rng = random.Random(7)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for _ in range(300):
        text = list(base)
        for k in rng.sample(range(len(text)), 6):
            text[k] = f"e{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    places, real = [], pe._members
    monkeypatch.setattr(pe, "_members", lambda *a: places.append(real(*a)) or places[-1])
    got = []
    rows_made = made(spark, lambda: got.extend(found(df, width=4, num=85, den=100)))
    assert got == brute(rows, 4, 85, 100)
    assert places[0].count() > 4 * len(rows)
    assert rows_made < 2 * places[0].count()


def test_blocks_of_a_star_meet_once(spark):
    """Nodes of different components meet in one unit, those of the largest not at all; rows by the number of blocks at most."""
    for blocks, inside in ((3, 0), (3, 20), (5, 50), (4, 59)):
        nodes = [(1, k, 0 if k < inside else k, blocks) for k in range(60)]
        units = collections.defaultdict(list)
        rows = pe._units_of_blocks(spark.createDataFrame(nodes, "star long, node long, comp long, blocks int")).collect()
        for r in rows:
            units[r["unit"]].append((r["node"], r["comp"], r["side"]))
        met = collections.Counter()
        for own in units.values():
            for (a, c, x), (b, d, y) in itertools.combinations(sorted(own), 2):
                if a != b and c != d and (x != y or x == 2):
                    met[a, b] += 1
        assert met == {(a, b): 1 for (_, a, c, _), (_, b, d, _) in itertools.combinations(nodes, 2) if c != d}
        assert len(rows) <= len(nodes) * (blocks + 1)


def test_repeated_rows_of_two_texts_give_one_set_each(spark, monkeypatch):
    """300 rows of each of two texts, under two ids or none: two sets, one pair, however the sets are fetched."""
    words = [f"w{k}" for k in range(60)]
    one, two = " ".join(words), " ".join([*words[:-1], "end"])
    held = []
    real = pe._sets
    monkeypatch.setattr(pe, "_sets", lambda *a: held.append(real(*a)) or held[-1])
    for ids in ((1, 2), (None, None)):
        df = spark.createDataFrame([(ids[0], one)] * 300 + [(ids[1], two)] * 300, "doc_id long, text string")
        for most in (1 << 20, 0):
            monkeypatch.setattr(pe, "_SENT", most)
            assert {r["component_id"] for r in pe.join(df).collect()} == {ids[0]}
            assert held[-1].count() == 2


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for num in (85, 70):
        bands = pe.Bands(num, 100)
        for size in (6, 7, 8, 10, 13, 21, 50, 130, 400):
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                b = a.copy()
                while True:
                    c = b[rng.random(len(b)) > 0.02] if rng.random() < 0.5 else np.unique(np.append(b, rng.integers(0, 2**63, 1, dtype=np.uint64)))
                    both = len(np.intersect1d(a, c))
                    if 100 * both < num * (len(a) + len(c) - both) or len(c) == 0:
                        break
                    b = c
                    if rng.random() < 0.1:
                        break
                if not np.array_equal(a, b):
                    assert len(np.intersect1d(pe.signatures(a, bands), pe.signatures(b, bands))) > 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["comp"] for r in pe.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in up)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert found(awkward, width=4, num=85, den=100) == brute(rows, 4, 85, 100)
    assert pe.join(empty).collect() == []
    kept = pe.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 5, 7, None], key=str)


def test_one_row_of_each_component_stays(spark):
    base = [f"w{k}" for k in range(40)]
    one, near, two, three = " ".join(base), " ".join([*base, "end"]), "some other text with seven words", "and a third one with eight words here"
    rows = [(1, one, "a"), (1, one, "a"), (1, one, "b"), (2, near, "c"), (2, two, "d"), (None, near, "e"), (None, three, "f"), (None, three, "f"), (None, "", "g"), (None, "", "g"), (3, None, "h"), (3, None, "h"), (3, two, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = sorted(((r["doc_id"], r["text"]) for r in pe.keep_one(df).collect()), key=str)
    want = [(1, one), (2, two), (None, three), (None, ""), (None, ""), (3, None), (3, None)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("size", [1, 2, 5, 6, 100, 10_000])
def test_bands_cover_every_size(size):
    bands = pe.Bands(85, 100)
    k = bands.band(size)
    assert bands.lows[k] <= size <= bands.highs[k]
    assert bands.highs[k] == bands.lows[k] * 100 // 85
