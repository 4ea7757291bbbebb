"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct runs of words. Documents of equal
sets are one node of the link graph. Sizes fall into bands such that a node can link only
within its band and the next; each pair of bands has a bound k on the symmetric
difference of linked sets. There the hash domain is cut into first-level partitions, one
of which must hold at most one difference (two, where k is small); each of these is cut
in three cells (five), and a signature is the content of two of the three (three of the
five). So two linked sets share at least one signature: no link is lost, and every
candidate is checked against the whole sets.

More partitions than the bound needs leave some to spare: a node may leave out its
weakest signatures (those of the fewest hashes) as long as fewer partitions are touched
than there are to spare. Of two linked nodes, the one that leaves out more still has a
common signature, which the other one keeps.

The least node of a signature is its centre, and all nodes that share a signature with a
centre are the centre's star, so two nodes of one signature always meet in a star. Rows
are (star, node), never pairs. In a star only nodes with a promising partner stay: a
node's profile counts its hashes in 256 parts of the domain, and the distance of two profiles
is never above the sets' difference. Then whole sets meet, and only a spanning forest of the
links found comes out: first each node in the first of its stars, which joins copies to
their centre; then the stars that still hold several components. A star of too many nodes
is compared in blocks: those of nodes outside its largest component meet each other and that
component's, and only nodes with a promising partner in a block they meet are brought with their sets. One of very many nodes
is first split by signatures of a second partitioning of the domain.

Defined results: texts without words (null, empty, white space) have size 0, link with
nothing and are components of their own. Rows with equal ids are separate rows; a
component's id is its least non-null document id. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomic.llm._bytes import U64, give_back, mix, shingle_hashes, text_slices, word_hashes
from fathomic.llm._spark import durable, partitions, release

_STRONG = 6
_SMALL_BOUND = 8
#: Nodes, and hashes of their sets, that are compared in one place.
_BLOCK = 1024
_HASHES = 1 << 20
#: Marks of texts, 8 bytes each, that may be sent to all executors; more are met by a shuffle of the texts.
_SENT = 1 << 20
#: A star of more blocks than this is split by a second partitioning.
_MANY = 16


def sets_of(buf: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words, first = word_hashes(buf, off)
    grams, at = shingle_hashes(words, first, width)
    return [np.unique(grams[at[i] : at[i + 1]]) for i in range(len(off) - 1)]


def node_of(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes()))))


def profile_of(hashes: np.ndarray) -> np.ndarray:
    """Counts of the hashes in 256 parts of the domain, 255 at most."""
    counts = np.bincount(((hashes >> U64(16)) & U64(0xFF)).astype(np.int64), minlength=256)
    return np.minimum(counts, 255).astype(np.uint8)


class Bands:
    """Size bands of a similarity threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.lows, self.highs = [0, 1], [0, den // num]

    def _grow(self, size: int) -> None:
        while self.highs[-1] < size:
            low = self.highs[-1] + 1
            self.lows.append(low)
            self.highs.append(low * self.den // self.num)

    def band(self, size: int) -> int:
        self._grow(size)
        lo, hi = 1, len(self.highs) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.highs[mid] < size:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def bound(self, band: int) -> int:
        """The greatest symmetric difference of linked sets, the smaller of them in this band."""
        high = self.highs[band]
        return (self.den - self.num) * (high + high * self.den // self.num) // (self.den + self.num)


def layout(k: int) -> tuple[int, int, int]:
    """(partitions of the first level, cells of each, differences that one of them may hold).

    A small bound affords to choose three cells of five, which covers more of a set;
    a large one takes two of three. Larger bounds also get partitions to spare.
    """
    cells, allowed = (5, 2) if k <= _SMALL_BOUND else (3, 1)
    return k // (allowed + 1) + 1 + (k - _SMALL_BOUND + 31) // 16 * (k > _SMALL_BOUND), cells, min(allowed, k)


def signatures(hashes: np.ndarray, bands: Bands, salt: int = 0) -> np.ndarray:
    """The node's signatures, for the pairs of bands that it is in; each salt partitions the domain anew."""
    own = bands.band(len(hashes))
    if salt:
        hashes = mix(hashes, salt)
    value = mix(hashes, 11)
    low, high = (value & U64(0xFFFFFFFF)).astype(np.float64), (value >> U64(32)).astype(np.float64)
    out = []
    for band in (own - 1, own):
        if band < 1 or (k := bands.bound(band)) == 0:
            continue
        n, cells, allowed = layout(k)
        cell = ((((hashes >> U64(32)) * U64(n)) >> U64(32)) * U64(cells) + (((hashes & U64(0xFFFF)) * U64(cells)) >> U64(16))).astype(np.int64)
        # sums of 32-bit halves are exact in doubles
        sums = np.stack([np.bincount(cell, weights=w, minlength=n * cells).reshape(n, cells) for w in (None, low, high)])
        chosen = _subsets(cells, cells - allowed)
        count, lows, highs = (sums @ chosen.T).astype(np.uint64)
        least = count.min(axis=1)
        spare = n - k // (allowed + 1)
        strong = next(t for t in range(_STRONG, -1, -1) if int((least < t).sum()) < spare)
        names = np.arange(count.size, dtype=np.uint64).reshape(count.shape) + U64(band << 32)
        found = mix(lows + (highs << U64(32)) + mix(names, 5) + count, 13)
        out.append(found[count >= strong])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@functools.cache
def _subsets(cells: int, size: int) -> np.ndarray:
    """A row for each choice of ``size`` cells: 1 where a cell is chosen."""
    rows = [[1.0 if c in pick else 0.0 for c in range(cells)] for pick in itertools.combinations(range(cells), size)]
    return np.array(rows)


def _measure(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, off in text_slices(batches):
            sets = sets_of(buf, off, width)
            nodes = [node_of(s) if len(s) else None for s in sets]
            profiles = [profile_of(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(profiles, pa.binary())], names=["doc_id", "mark", "n_shingles", "node", "profile"])

    return run


def _packed(found: Iterator[tuple[np.ndarray, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, sigs, nodes): signatures and nodes of many sets, packed by signature range."""
    held: list[tuple[np.ndarray, int]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        sig = np.concatenate([s for s, _ in held])
        node = np.repeat(np.array([n for _, n in held], np.int64), [len(s) for s, _ in held])
        bucket = ((sig >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sig, node, bucket = sig[order], node[order], bucket[order]
        starts = np.flatnonzero(np.append(True, np.diff(bucket) != 0))
        ends = np.append(starts[1:], len(sig))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts], pa.int64()), pa.array([sig[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([node[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
            names=["bucket", "sigs", "nodes"],
        )

    for sigs, node in found:
        if len(sigs):
            held.append((sigs, node))
            size += len(sigs)
        if size >= 2 << 20:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _sign(width: int, num: int, den: int, buckets: int):
    """Packed signatures of texts; copies within a task are signed once."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        bands = Bands(num, den)
        seen: set[int] = set()
        for _, buf, off in text_slices(batches):
            for s in sets_of(buf, off, width):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(node)
                yield signatures(s, bands), node

    return lambda batches: _packed(signed(batches), buckets)


def _sign_again(num: int, den: int, buckets: int):
    """Packed signatures of the sets of large stars, by a second partitioning; those of different stars differ."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        bands = Bands(num, den)
        for b in batches:
            for star, node, hashes in zip(b.column("star").to_pylist(), b.column("node").to_pylist(), b.column("hashes"), strict=True):
                found = signatures(np.frombuffer(hashes.as_buffer(), np.uint64), bands, salt=17)
                yield mix(found ^ U64(star & 0xFFFFFFFFFFFFFFFF), 19), node

    return lambda batches: _packed(signed(batches), buckets)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from the least node of each signature to its others, each once."""
    sigs, nodes = [], []
    for b in batches:
        for s, n in zip(b.column(1), b.column(2), strict=True):
            sigs.append(np.frombuffer(s.as_buffer(), np.uint64))
            nodes.append(np.frombuffer(n.as_buffer(), np.int64))
    if not sigs:
        return
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    del sigs, nodes
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    del order
    new = np.append(True, sig[1:] != sig[:-1])
    starts = np.flatnonzero(new)
    least = np.repeat(node[starts], np.diff(np.append(starts, len(sig))))
    other = node != least
    pairs = np.unique(np.stack([least[other], node[other]], axis=1), axis=0)
    for k in range(0, len(pairs), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 18), 0]), pa.array(pairs[k : k + (1 << 18), 1])], names=["a", "b"])
    del sig, node, new, starts, least, other, pairs
    give_back()


def _members(packed: DataFrame, buckets: int) -> DataFrame:
    """(star, node): each centre and the nodes that share a signature with it."""
    edges = packed.repartition(buckets, "bucket").mapInArrow(_stars, "a long, b long").distinct()
    # the centre itself comes with its edges, so that no second pass over them is needed
    return edges.select(F.col("a").alias("star"), F.explode(F.array("a", "b")).alias("node")).distinct()


def near(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows (profiles p, sizes n; q, m) may be linked: sizes alike and profiles within the bound."""
    ok = (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (n > 0)
    distance = np.abs(p.astype(np.int16) - q.astype(np.int16)).sum(axis=-1, dtype=np.int64)
    return ok & (distance <= (den - num) * (n + m) // (den + num))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of equal ``key`` of rows that come by key, many at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _promising(num: int, den: int):
    """The rows (unit, node, comp, side) that have a partner in their unit within the bound. Rows come by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "unit"):
            unit, n, comp, side = (t.column(c).to_numpy() for c in ("unit", "n", "comp", "side"))
            profile = np.frombuffer(b"".join(t.column("profile").to_pylist()), np.uint8).reshape(-1, 256)
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            sizes = np.diff(np.append(starts, len(unit)))
            keep = np.zeros(len(unit), bool)
            twos = starts[sizes == 2]
            keep[twos] = keep[twos + 1] = near(profile[twos], n[twos], profile[twos + 1], n[twos + 1], num, den)
            for a, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                order = a + np.argsort(n[a : a + size], kind="stable")
                m, vectors, c, d = n[order], profile[order], comp[order], side[order]
                # partners are no smaller, and small enough
                high = np.searchsorted(m, m * den // num, side="right")
                for i in range(size - 1):
                    j = slice(i + 1, int(high[i]))
                    ok = (c[j] != c[i]) & ((d[j] == 2) | (d[j] != d[i]))
                    if ok.any():
                        ok[ok] = near(vectors[i], m[i], vectors[j][ok], m[j][ok], num, den)
                        if ok.any():
                            keep[order[i]] = True
                            keep[order[j][ok]] = True
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(keep)) for c in ("unit", "node", "comp", "side")], names=["unit", "node", "comp", "side"])

    return run


def links_among(node: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A forest of links that joins the components of linked nodes.

    Sides 0 and 1 are compared with each other and with side 2, which is also compared
    within itself. Pairs of one component need no comparison, and components grow as links are found.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    node, side, sets = node[order], side[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    _, comp = np.unique(comp[order], return_inverse=True)
    starts = np.append(0, np.cumsum(size))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), np.int32)
    high = np.searchsorted(size, size * den // num, side="right")
    out = []
    for i in range(len(node) - 1):
        j = np.arange(i + 1, high[i])
        j = j[(comp[j] != comp[i]) & ((side[j] == 2) | (side[j] != side[i])) & (node[j] != node[i])]
        if not len(j):
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = 1
        if 2 * len(j) > j[-1] + 1 - j[0]:
            first, last = j[0], j[-1] + 1
            both = np.add.reduceat(mark[ids[starts[first] : starts[last]]], starts[first:last] - starts[first])[j - first]
        else:
            both = np.array([int(mark[ids[starts[k] : starts[k + 1]]].sum()) for k in j])
        mark[own] = 0
        for k in j[den * both >= num * (size[i] + size[j] - both)]:
            if comp[k] != comp[i]:
                out.append((int(node[i]), int(node[k])))
                comp[comp == comp[k]] = comp[i]
    return out


def _linked(num: int, den: int):
    """Links (a, b) among the rows of each unit (node, comp, side, hashes). Rows come by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "unit"):
            unit = t.column("unit").to_numpy()
            node, comp, side = (t.column(c).to_numpy() for c in ("node", "comp", "side"))
            hashes = t.column("hashes").combine_chunks()
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])).tolist()
            out = []
            for a, b in zip(starts, [*starts[1:], len(unit)], strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(hashes[k].as_buffer(), np.uint64) for k in range(a, b)]
                    out += links_among(node[a:b], comp[a:b], side[a:b], sets, num, den)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
            give_back()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b) but the least of each component: the least node it is connected to.

    Alternates the large star and the small star until each component is one star.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not _stars_only(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = durable(small.filter("u <> v").distinct())
        release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node with a lesser neighbour has one of these and no greater ones."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _open(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows`` (star, node, ...) with ``comp``, of the stars that hold several components."""
    rows = rows.withColumn("comp", F.col("node")) if comp is None else durable(rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    several = rows.groupBy("star").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("star")
    return rows.join(several, "star", "left_semi")


def _sized(rows: DataFrame) -> DataFrame:
    """``rows`` (star, node, n) with the number of blocks of each star."""
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(_BLOCK)), F.ceil(F.sum("n") / F.lit(_HASHES))).cast("int")
    # a star of two nodes is one block, however long they are
    return rows.join(rows.groupBy("star").agg(F.when(F.count("*") > 2, blocks).otherwise(1).alias("blocks")), "star")


def _units_of_blocks(rows: DataFrame) -> DataFrame:
    """Units of stars of several blocks: two blocks each, or one with itself.

    Blocks of nodes outside the largest component come first and meet each other and those of
    that component, so two nodes of different components meet in one unit.
    """
    shares = rows.groupBy("star", "comp").agg(F.count("*").alias("m"))
    big = shares.groupBy("star").agg(F.max_by("comp", F.struct("m", "comp")).alias("big"), (F.max("m") / F.sum("m")).alias("share"))
    rows = rows.join(big, "star")
    few, rest = (F.greatest(F.lit(1), F.ceil(F.col("blocks") * part)).cast("int") for part in (1 - F.col("share"), F.col("share")))
    rows = rows.withColumn("few", few).withColumn("rest", rest).withColumn("inside", F.col("comp") == F.col("big"))
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("inside"), F.col("rest")).otherwise(F.col("few"))).cast("int")
    rows = rows.withColumn("mine", F.when(F.col("inside"), F.col("few")).otherwise(0) + own)
    last = F.col("few") + F.when(F.col("inside"), 0).otherwise(F.col("rest")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    return rows.withColumn("side", side).withColumn("unit", F.xxhash64("star", F.least("mine", "other"), F.greatest("mine", "other")))


def node_components(rows: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame | None:
    """(node, comp) of the nodes that link with another; None if there are none.

    ``rows``: doc_id, mark, n_shingles, node, profile of each document; ``texts``: mark, text.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    # about half a signature for each shingle, a million of them a bucket; a star's edge may come from each
    # bucket, so there are no more of them than the data ask for
    buckets = total // (1 << 21) + 1
    packed = texts.select("text").mapInArrow(_sign(width, num, den, buckets), "bucket long, sigs binary, nodes binary")
    facts = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("profile").alias("profile"), F.min("mark").alias("mark"))
    members = durable(_members(packed, buckets))
    del packed
    release(spark)
    if members.isEmpty():
        return None
    # sizes and profiles come once and stay with the rows
    members = durable(members.join(facts.select("node", "n", "profile"), "node"))
    members = durable(_sized(members))
    release(spark)
    fields = ["unit", "node", "comp", "side"]

    def dealt(units: DataFrame) -> DataFrame:
        return units.repartition(partitions(spark), "unit").sortWithinPartitions("unit")

    def promising(units: DataFrame) -> DataFrame:
        out = durable(dealt(units.select(*fields, "n", "profile")).mapInArrow(_promising(num, den), "unit long, node long, comp long, side int"))
        release(spark)
        return out

    def found(units: DataFrame) -> DataFrame:
        out = durable(dealt(units.join(sets, "node").select(*fields, "hashes")).mapInArrow(_linked(num, den), "a long, b long"))
        release(spark)
        return out

    small = promising(_whole(members.filter("blocks = 1").withColumn("comp", F.col("node")))).select(F.col("unit").alias("star"), "node", F.lit(1).alias("blocks"))
    large = durable(members.filter("blocks > 1"))
    chosen = durable(small.unionByName(large.select("star", "node", "blocks")))
    del members, small
    release(spark)
    sets = _sets(texts, chosen.select("node").distinct().join(facts.select("node", "mark"), "node").select("mark").distinct(), width)
    release(spark)

    # each node in the first of its stars, with the star's centre in every part of a large one
    first = chosen.groupBy("node").agg(F.min_by(F.struct("star", "blocks"), "star").alias("s")).select("node", "s.star", "s.blocks")
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("blocks"))
    centres = first.filter("node <> star").select("star", "blocks").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = first.filter("node <> star").select("star", "node", part.cast("int").alias("part")).unionByName(centres.select("star", F.col("star").alias("node"), "part"))
    comp = _joined(found(units.select(F.xxhash64("star", "part").alias("unit"), "node", F.col("node").alias("comp"), F.lit(2).alias("side"))), None)
    more = found(_whole(_open(chosen.filter("blocks = 1").select("star", "node"), comp)))
    large = durable(_open(large, comp))
    if large.isEmpty():
        return _joined(more, comp)
    parted = _units_of_blocks(large.filter(F.col("blocks") <= _MANY)).select(*fields, "n", "profile")
    many = large.filter(F.col("blocks") > _MANY)
    if not many.isEmpty():
        resigned = many.select("star", "node").join(sets, "node").select("star", "node", "hashes").mapInArrow(_sign_again(num, den, buckets), "bucket long, sigs binary, nodes binary")
        again = many.groupBy("node").agg(F.first("n").alias("n"), F.first("profile").alias("profile"))
        stars = durable(_sized(durable(_open(durable(_members(resigned, buckets)), comp).join(again, "node"))))
        for rows_ in (_whole(stars.filter("blocks = 1")), _units_of_blocks(stars.filter("blocks > 1"))):
            parted = parted.unionByName(rows_.select(*fields, "n", "profile"))
    return _joined(more.unionByName(found(promising(parted))), comp)


def _whole(rows: DataFrame) -> DataFrame:
    """Units of stars (star, node, comp) that are compared at once."""
    return rows.withColumn("unit", F.col("star")).withColumn("side", F.lit(2))


def _joined(links: DataFrame, comp: DataFrame | None) -> DataFrame | None:
    """The components ``comp``, joined by ``links``."""
    if links.isEmpty():
        return comp
    return durable(components(links if comp is None else links.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))))


def _sets(texts: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the texts of ``marks``, each node once."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, off in text_slices(batches):
            sets = {node_of(s): s for s in sets_of(buf, off, width) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["node", "hashes"])

    # repeated rows share a mark; few marks are sent to the texts, which then stay where they are
    marks = durable(marks)
    sent = F.broadcast(marks) if marks.count() <= _SENT else marks.hint("merge")
    wanted = texts.join(sent, "mark", "left_semi").select("text").mapInArrow(collect, "node long, hashes binary")
    return durable(wanted.groupBy("node").agg(F.first("hashes").alias("hashes")))


def _mark(id_: F.Column, text: F.Column) -> F.Column:
    """A number that rows share where id and text are equal."""
    return F.xxhash64(id_.cast("long").isNull(), id_.cast("long"), text.isNull(), text)


def _placed(df: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (doc_id, mark, n_shingles, node, profile) of ``df``, and the components of their nodes."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("mark", _mark(F.col("doc_id"), F.col("text"))).select("doc_id", "mark", "text")
    rows = durable(texts.mapInArrow(_measure(width), "doc_id long, mark long, n_shingles long, node long, profile binary"))
    return rows, node_components(rows, texts.select("mark", "text"), width, num, den)


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Columns doc_id, n_shingles and component_id of every row; links need Jaccard >= num / den."""
    rows, comp = _placed(df, id_col, text_col, width, num, den)
    # a node's least document id, then the least over the nodes of a component
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    if comp is None:
        named = nodes.withColumnRenamed("least", "component_id")
    else:
        placed = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
        named = placed.join(least, "comp").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, and every row without words; all columns stay.

    It is the row of the least id, a null id being the last. Of rows with equal ids and
    texts one stays, whatever ids other components have.
    """
    rows, comp = _placed(df, id_col, text_col, width, num, den)
    worded = rows.filter("node is not null").select("node", "doc_id", "mark")
    placed = worded.withColumn("comp", F.col("node")) if comp is None else worded.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("one"))
    kept = least.select(F.col("one.mark").alias("__mark"), F.lit(False).alias("__all"))
    kept = kept.unionByName(rows.filter("node is null").select(F.col("mark").alias("__mark"), F.lit(True).alias("__all")).distinct())
    found = df.withColumn("__mark", _mark(F.col(id_col), F.col(text_col))).join(kept, "__mark")
    first = Window.partitionBy("__mark").orderBy(F.xxhash64(*[F.col(c) for c in df.columns if c not in (id_col, text_col) and "map<" not in dict(df.dtypes)[c]] or [F.lit(0)]))
    return found.withColumn("__place", F.row_number().over(first)).filter("__all OR __place = 1").select(df.columns)
