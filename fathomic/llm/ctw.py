"""LM scoring by context-tree weighting over bytes.

A text (A-Z lower-cased) is its UTF-8 bytes and an end symbol. Each byte is eight binary
decisions; a decision's context is the bytes before it. Every context of 0 to ``depth``
bytes keeps Krichevsky-Trofimov estimates of its decisions, and context-tree weighting
mixes them over all depths: a node's probability is half its own estimate and half the
product of its children's. The trained tree gives each byte's code length.

Counts come from every training text and every context is kept, however rare. Units of
rows (file blocks) ask for their distinct runs of ``depth + 1`` bytes with their training
counts. A shuffle brings the requests of one context of ``SPLIT`` bytes together: a task
merges them to the context's part of the model, a table that stays distributed, and the
subtree under it is weighted there. Only the contexts above, at most 256 of one byte, meet
on the driver. A second shuffle brings model and requests together again, and the scores
of a unit's runs come back to the unit and meet its texts there.

The base score needs each token's count over the whole corpus, and the vocabulary has no
bound. So each unit of rows (a file block) asks once for each of its distinct words; the
answers come back to the unit and meet its texts there. Nothing grows on the driver.

Defined results: null counts as empty text, which is the end symbol alone; without
training texts every byte decision has probability 1/2 and known tokens are none; rows
may repeat and ids may be null (a null id is never held out).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomic.llm._bytes import LOWER, U64, give_back, mix, text_slices, word_hashes
from fathomic.llm._spark import durable, parts_for, release

DEPTH = 5
LEAST = 2.0**-16
#: Bytes of the contexts that subtrees are dealt out by; what lies above them is bounded by the bytes there are.
SPLIT = 2
#: Runs held by a task before equal ones are merged, and slots of a task's table of known runs.
_HELD = 3 << 19
#: Bytes of text handled at once.
_SLICE = 1 << 20
_SLOTS = 20


def runs(buf: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol its context, the nearest byte first, and itself, as one number; n + 1 row offsets.

    Contexts before the text, and the end symbol, are byte 255, which UTF-8 never has.
    """
    rows = len(off) - 1
    sizes = np.diff(off)
    padded = np.full(len(buf) + rows * (depth + 1), 255, np.uint8)
    row = np.repeat(np.arange(rows), sizes)
    padded[np.arange(len(buf)) + row * (depth + 1) + depth] = LOWER[buf]
    wide = padded.astype(np.uint64)
    n = len(padded) - depth
    key = np.zeros(n, np.uint64)
    for d in range(1, depth + 1):
        key = (key << U64(8)) | wide[depth - d : depth - d + n]
    key = (key << U64(8)) | wide[depth:]
    own = np.ones(n, bool)
    # a row's first ``depth`` places are padding of the row after the first
    ends = np.cumsum(sizes + depth + 1) - depth
    for d in range(depth):
        at = ends[:-1] + d
        own[at] = False
    return key[own].astype(np.int64), np.append(0, np.cumsum(sizes + 1))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[starts], np.add.reduceat(c, starts)


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for _, buf, off in text_slices(batches, limit=_SLICE):
            key, _ = runs(buf, off, depth)
            key.sort()
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            keys.append(key[starts])
            counts.append(np.diff(np.append(starts, len(key))))
            held += len(starts)
            if held >= _HELD:
                k, c = _merged(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held >= _HELD // 2:
                    yield _pairs(k, c)
                    keys, counts, held = [], [], 0
        if keys:
            yield _pairs(*_merged(keys, counts))
        keys, counts = [], []
        give_back()

    return run


def _pairs(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c.astype(np.int64))], names=["run", "n"])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers: recurrence, then Stirling's series."""
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift = np.where(small, shift * y, shift)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of any sequence with these counts under the Krichevsky-Trofimov estimator."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - math.log(math.pi) - _lgamma(zeros + ones + 1.0)


@dataclass
class Depth:
    """One depth's contexts, decision nodes (context number * 256 + prefix) and symbols seen."""

    contexts: np.ndarray
    nodes: np.ndarray
    stop: np.ndarray  # P(1) where the kept path ends at this context
    mass: np.ndarray  # P(1) from this depth and above
    rest: np.ndarray  # weight left for deeper contexts
    symbols: np.ndarray
    scores: np.ndarray  # log10 probability of the symbol where the path ends here

    def packed(self) -> Depth:
        """Weights in single precision, and node numbers in 32 bits where they fit."""
        small = np.int32 if len(self.contexts) < 1 << 23 else np.int64
        stop, mass, rest = (x.astype(np.float32) for x in (self.stop, self.mass, self.rest))
        return Depth(self.contexts, self.nodes.astype(small), stop, mass, rest, self.symbols.astype(small), self.scores)


class Tree:
    """Trained weights; bounded by the number of kept contexts."""

    def __init__(self, depths: list[Depth], depth: int) -> None:
        self.depths, self.depth = depths, depth

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each run's last byte."""
        out = np.full(len(keys), 8 * math.log10(0.5))
        if not self.depths or not len(self.depths[0].contexts):
            return out
        symbol = keys & 255
        level = np.zeros(len(keys), np.int64)
        number = np.zeros((self.depth + 1, len(keys)), np.int64)
        alive = np.arange(len(keys))
        for d in range(1, self.depth + 1):
            if not len(self.depths[d].contexts) or not len(alive):
                break
            own = keys[alive] >> (8 * (self.depth + 1 - d))
            at = np.minimum(np.searchsorted(self.depths[d].contexts, own), len(self.depths[d].contexts) - 1)
            ok = self.depths[d].contexts[at] == own
            alive = alive[ok]
            level[alive] = d
            number[d, alive] = at[ok]
        for d, deep in enumerate(self.depths):
            which = np.flatnonzero(level == d)
            if not len(which):
                continue
            want = (number[d, which] * 256 + symbol[which]).astype(deep.symbols.dtype)
            at = np.minimum(np.searchsorted(deep.symbols, want), len(deep.symbols) - 1)
            ok = deep.symbols[at] == want
            out[which[ok]] = deep.scores[at[ok]]
            new = which[~ok]
            if len(new):
                out[new] = self._unseen(d, number[:, new], symbol[new])
        return out

    def _unseen(self, level: int, number: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Symbols new to their contexts: nodes that those have not seen leave the choice to the depths above."""
        total = np.zeros(len(symbol))
        for j in range(8):
            prefix, bit = (1 << j) | (symbol >> (8 - j)), ((symbol >> (7 - j)) & 1).astype(bool)
            p = np.full(len(symbol), 0.5)
            open_ = np.arange(len(symbol))
            for d in range(level, -1, -1):
                deep = self.depths[d]
                want = number[d, open_] * 256 + prefix[open_]
                at = np.minimum(np.searchsorted(deep.nodes, want.astype(deep.nodes.dtype)), len(deep.nodes) - 1)
                ok = deep.nodes[at] == want
                found = at[ok]
                p[open_[ok]] = deep.stop[found] if d == level else deep.mass[found] + deep.rest[found] * 0.5
                open_ = open_[~ok]
                if not len(open_):
                    break
            total += np.log10(np.where(bit, p, 1 - p))
        return total


def _decisions(context: np.ndarray, symbol: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted decision nodes of entries sorted by (context, symbol), and zeros and ones of each kind of count."""
    if not len(symbol):
        return np.zeros(0, np.int64), [(np.zeros(0), np.zeros(0)) for _ in counts]
    nodes, sums = [], [([], []) for _ in counts]
    for j in range(8):
        key = context * 256 + ((1 << j) | (symbol >> (8 - j)))
        bit = ((symbol >> (7 - j)) & 1).astype(bool)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        nodes.append(key[starts])
        for (zeros, ones), n in zip(sums, counts, strict=True):
            zeros.append(np.add.reduceat(np.where(bit, 0, n), starts))
            ones.append(np.add.reduceat(np.where(bit, n, 0), starts))
    key = np.concatenate(nodes)
    order = np.argsort(key)
    return key[order], [(np.concatenate(z)[order].astype(float), np.concatenate(o)[order].astype(float)) for z, o in sums]


def _stages(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], whole: bool) -> list:
    """Contexts, entries and decision nodes of consecutive depths. ``whole``: all contexts below the last depth are kept."""
    stages = []
    for k, (context, symbol, n) in enumerate(entries):
        contexts, number = np.unique(context, return_inverse=True)
        other = n.copy()
        if k + 1 < len(entries) and len(entries[k + 1][0]):
            below, sym, m = entries[k + 1]
            at = np.searchsorted(context * 256 + symbol, (below >> 8) * 256 + sym)
            other -= np.bincount(at, weights=m, minlength=len(n)).astype(np.int64)
        elif whole:
            other[:] = 0
        nodes, (own, rest) = _decisions(number, symbol, n, other)
        stages.append([contexts, number, symbol, nodes, own, rest])
    return stages


def _above(deep: list, over: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The nodes' numbers among those (contexts ``over``, ``nodes``) of the depth above."""
    contexts, own = deep
    return np.searchsorted(nodes, np.searchsorted(over, contexts >> 8)[own >> 8] * 256 + (own & 255)) if len(own) else np.zeros(0, np.int64)


def _upward(stages: list, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weighted log probabilities of the first depth's nodes, and each depth's weights.

    ``below``: the sums of what lies under the last depth, by context * 256 + prefix;
    without it the last depth is the deepest.
    """
    weight: list[np.ndarray] = [np.zeros(0)] * len(stages)
    up = np.zeros(0)
    for k in range(len(stages) - 1, -1, -1):
        contexts, _, _, nodes, own, rest = stages[k]
        estimate = _kt(*own)
        if k == len(stages) - 1 and below is None:
            up, weight[k] = estimate, np.ones(len(nodes))
            continue
        children = _kt(*rest)
        if k == len(stages) - 1:
            if len(nodes):
                children = children + below[1][np.searchsorted(below[0], contexts[nodes >> 8] * 256 + (nodes & 255))]
        elif len(stages[k + 1][3]):
            at = _above([stages[k + 1][0], stages[k + 1][3]], contexts, nodes)
            children = children + np.bincount(at, weights=up, minlength=len(nodes))
        up = np.logaddexp(estimate, children) - math.log(2)
        weight[k] = np.exp(estimate - math.log(2) - up)
    return up, weight


def _downward(stages: list, weight: list[np.ndarray], above: Depth | None) -> list[Depth]:
    """The depths' probabilities; ``above`` is the depth over the first one."""
    depths: list[Depth] = []
    for (contexts, number, symbol, nodes, own, rest), w in zip(stages, weight, strict=True):
        over = depths[-1] if depths else above
        if over is None:
            mass, left = np.zeros(len(nodes)), np.ones(len(nodes))
        else:
            at = _above([contexts, nodes], over.contexts, over.nodes)
            mass, left = over.mass[at], over.rest[at]
        likely = (own[1] + 0.5) / (own[0] + own[1] + 1)
        mass = mass + left * w * likely
        left = left * (1 - w)
        stop = mass + left * (rest[1] + 0.5) / (rest[0] + rest[1] + 1)
        score = np.zeros(len(symbol))
        for j in range(8):
            at = np.searchsorted(nodes, number * 256 + ((1 << j) | (symbol >> (8 - j))))
            one = ((symbol >> (7 - j)) & 1).astype(bool)
            score += np.log10(np.where(one, stop[at], 1 - stop[at]))
        depths.append(Depth(contexts, nodes, stop, mass, left, number * 256 + symbol, score))
    return depths


def build(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> Tree:
    """``entries``: for each depth the (context, symbol, count) arrays of kept contexts, sorted."""
    if not entries or not len(entries[0][0]):
        return Tree([], depth)
    stages = _stages(entries, False)
    return Tree([d.packed() for d in _downward(stages, _upward(stages, None)[1], None)], depth)


def _entries(run: np.ndarray, n: np.ndarray, first: int, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted (context, symbol, count) arrays of depths ``first`` to ``depth`` of distinct runs of ``depth + 1`` bytes."""
    out = []
    for d in range(first, depth + 1):
        key, m = run, n
        if len(run):
            key, m = _merged([((run >> (8 * (depth + 1 - d))) << 8) | (run & 255)], [n])
        out.append((key >> 8, key & 255, m))
    return out


def train(df: DataFrame, text_col: str = "text", depth: int = DEPTH, least: float = LEAST) -> Tree:
    """The weighted tree of every text of ``df`` in one piece, of contexts with at least the share ``least`` of all symbols."""
    spark = df.sparkSession
    counted = df.select(F.col(text_col).alias("text")).mapInArrow(_count(depth), "run long, n long")
    counted = durable(counted.groupBy("run").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("run", 8 * (depth + 1 - d)).alias("context"), F.col("run").bitwiseAND(F.lit(255)).alias("symbol")) for d in range(depth + 1)]))
    each = counted.select(levels.alias("x"), "n").groupBy("x.d", "x.context", "x.symbol").agg(F.sum("n").alias("n"))
    kept = each.groupBy("d", "context").agg(F.sum("n").alias("all"), F.collect_list(F.struct("symbol", "n")).alias("seen")).filter(F.col("all") >= F.lit(total * least))
    table = kept.select("d", "context", F.explode("seen").alias("s")).select("d", "context", "s.symbol", "s.n").toArrow()
    release(spark)
    d, context, symbol, n = (table.column(c).to_numpy().astype(np.int64) for c in ("d", "context", "symbol", "n"))
    entries = []
    for k in range(depth + 1):
        own = np.flatnonzero(d == k)
        own = own[np.lexsort((symbol[own], context[own]))]
        entries.append((context[own], symbol[own], n[own]))
    return build(entries, depth)


def _low(depth: int, split: int) -> tuple[int, type]:
    """Bits of a run under its context of ``split`` bytes, and a type that holds them."""
    bits = 8 * (depth + 1 - split)
    return bits, np.uint32 if bits <= 32 else np.uint64


def _asked_runs(depth: int, split: int):
    """Rows (unit, context, runs, counts): a unit's distinct runs by context, and how often its training texts have them.

    A unit may ask for a run more than once, as equal runs are merged only while a task holds them.
    """
    bits, kind = _low(depth, split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        size = 0

        def rows(unit: int) -> pa.RecordBatch:
            k, c = held[unit][0][0], held[unit][1][0]
            context = k >> bits
            starts = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            ends = np.append(starts[1:], len(k))
            low, c = (k & ((1 << bits) - 1)).astype(kind), c.astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), unit)), pa.array(context[starts]), pa.array([low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                names=["unit", "context", "runs", "counts"],
            )

        def merged() -> int:
            for u, (k, c) in held.items():
                k, c = _merged(k, c)
                held[u] = [k], [c]
            return sum(len(k[0]) for k, _ in held.values())

        for part, buf, off in text_slices(batches, limit=_SLICE):
            key, at = runs(buf, off, depth)
            sizes = np.diff(at)
            key = (key << 1) | np.repeat((~part.column("held_out").to_numpy(zero_copy_only=False)).astype(np.int64), sizes)
            unit = part.column("unit").to_numpy()
            for u in np.unique(unit):
                own = np.sort(key[np.repeat(unit == u, sizes)])
                k = own >> 1
                starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                ks, cs = held.setdefault(int(u), ([], []))
                ks.append(k[starts])
                cs.append(np.add.reduceat(own & 1, starts))
                size += len(starts)
            if size >= _HELD:
                size = merged()
                if size >= _HELD // 2:
                    for u in held:
                        yield rows(u)
                    held, size = {}, 0
        merged()
        for u in held:
            yield rows(u)
        held = {}
        give_back()

    return run


def _rows_by_context(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, np.ndarray | None, np.ndarray | None]]:
    """(context, unit, runs, counts) of rows sorted by context; a None at the end."""
    for b in batches:
        for row in zip(b.column("context").to_pylist(), b.column("unit").to_pylist(), b.column("runs"), b.column("counts"), strict=True):
            yield row[0], row[1], row[2].as_buffer(), row[3].as_buffer()
    yield None, 0, None, None


def _model(depth: int, split: int):
    """From requests sorted by context: rows (context, runs, counts) of the model, and rows (key, symbols, up) for the depth above.

    A key is a context of ``split - 1`` bytes * 256 and a symbol, or a node's prefix after 2^62.
    """
    bits, kind = _low(depth, split)
    names = ["unit", "context", "runs", "counts", "key", "n", "up"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held, before = 0, None
        for context, _, k, c in _rows_by_context(batches):
            if context != before and keys:
                k_, c_ = _merged(keys, counts)
                k_, c_ = k_[c_ > 0], c_[c_ > 0]
                keys, counts, held = [], [], 0
                for a in range(0, len(k_), 1 << 20):
                    part, m = k_[a : a + (1 << 20)], c_[a : a + (1 << 20)]
                    nothing = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([before]), pa.array([part.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), *nothing], names=names)
                if len(k_) and split:
                    entries = _entries((before << bits) | k_.astype(np.int64), c_, split, depth)
                    stages = _stages(entries, True)
                    up, _ = _upward(stages, None)
                    (_, symbol, n), nodes, over = entries[0], stages[0][3], (before >> 8) * 256
                    key = np.concatenate([over + symbol, (1 << 62) + over + nodes])
                    total, ups = np.append(n, np.zeros(len(nodes), np.int64)), np.append(np.zeros(len(n)), up)
                    empty = [pa.nulls(len(key), x) for x in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array(key), pa.array(total), pa.array(ups)], names=names)
            before = context
            if context is None:
                break
            keys.append(np.frombuffer(k, kind))
            counts.append(np.frombuffer(c, np.uint32).astype(np.int64))
            held += len(keys[-1])
            if held >= 2 * _HELD and len(keys) > 1:
                k_, c_ = _merged(keys, counts)
                keys, counts, held = [k_], [c_], 0
        give_back()

    return run


def _top(model: DataFrame, depth: int, split: int) -> list[Depth]:
    """The depths above the dealt subtrees, from at most 256^split symbols and as many nodes."""
    if not split:
        return []
    found = model.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n"), F.sum("up").alias("up")).orderBy("key").toArrow()
    key, n, up = (found.column(c).to_numpy() for c in ("key", "n", "up"))
    node = key >= 1 << 62
    stages = _stages(_entries(key[~node], n[~node], 0, split - 1), True)
    return _downward(stages, _upward(stages, (key[node] - (1 << 62), up[node]))[1], None)


def _run_answers(shared, depth: int, split: int):
    """From rows sorted by context, the model's first: the requests with scores for counts."""
    bits, kind = _low(depth, split)
    names = ["unit", "context", "runs", "scores"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        before, tree, size = None, None, 0
        learned: list[tuple[np.ndarray, np.ndarray]] = []
        k_, scores = np.zeros(0, np.int64), np.zeros(0)
        out: list[tuple[int, int, bytes, bytes]] = []

        def batch() -> pa.RecordBatch:
            u, c, r, s = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.binary()), pa.array(s, pa.binary())], names=names)

        for context, unit, k, c in _rows_by_context(batches):
            if context is None:
                break
            if context != before:
                before, tree, learned = context, None, []
            if unit is None:
                learned.append((np.frombuffer(k, kind), np.frombuffer(c, np.int64)))
                continue
            if tree is None:
                k_ = np.concatenate([np.zeros(0, np.int64), *((context << bits) | x.astype(np.int64) for x, _ in learned)])
                n = np.concatenate([np.zeros(0, np.int64), *(m for _, m in learned)])
                order = np.argsort(k_, kind="stable")
                k_, n, learned = k_[order], n[order], []
                stages = _stages(_entries(k_, n, split, depth), True)
                deep = _downward(stages, _upward(stages, None)[1], top[-1] if top else None)
                tree = Tree([*top, *deep], depth)
                scores = deep[-1].scores
            want = (context << bits) | np.frombuffer(k, kind).astype(np.int64)
            if len(k_):
                at = np.minimum(np.searchsorted(k_, want), len(k_) - 1)
                answer = scores[at]
                new = np.flatnonzero(k_[at] != want)
                if len(new):
                    answer[new] = tree.score(want[new])
            else:
                answer = tree.score(want)
            out.append((unit, context, k.to_pybytes(), answer.astype(np.float32).tobytes()))
            size += len(want)
            if size >= 1 << 18:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()
        give_back()

    return run


def _requests(buckets: int):
    """Rows (unit, bucket, words, counts): a unit's distinct words and how often its training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray], int]] = {}

        def flush(unit: int) -> pa.RecordBatch:
            words, counts, _ = held.pop(unit)
            w, c = _merged(words, counts)
            order = np.argsort((w >> U64(33)) * U64(buckets) >> U64(31), kind="stable")
            w, c = w[order], c[order]
            bucket = ((w >> U64(33)) * U64(buckets) >> U64(31)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(starts[1:], len(w))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), unit)), pa.array(bucket[starts]), pa.array([w[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([c[a:b].astype(np.int64).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                names=["unit", "bucket", "words", "counts"],
            )

        for part, buf, off in text_slices(batches, limit=_SLICE):
            words, first = word_hashes(buf, off)
            unit = part.column("unit").to_numpy()
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            sizes = np.diff(first)
            by_word = np.repeat(unit, sizes)
            flag = np.repeat(train, sizes).astype(np.int64)
            for u in np.unique(unit):
                own = by_word == u
                if not own.any():
                    continue
                w, c = _merged([words[own]], [flag[own]])
                ws, cs, n = held.get(int(u), ([], [], 0))
                held[int(u)] = (ws + [w], cs + [c], n + len(w))
                if n + len(w) > 2 * _HELD:
                    w, c = _merged(*held[int(u)][:2])
                    held[int(u)] = ([w], [c], 0)
        for u in list(held):
            yield flush(u)
        give_back()

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with corpus counts for counts, and a row without unit that has the counts' number and sum."""
    rows = [(u.as_py(), np.frombuffer(w.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)) for b in batches for u, w, c in zip(b.column("unit"), b.column("words"), b.column("counts"), strict=True)]
    if not rows:
        return
    words, counts = _merged([r[1] for r in rows], [r[2] for r in rows])
    names = ["unit", "words", "counts", "distinct", "total"]
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([int((counts > 0).sum())], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=names)
    for k in range(0, len(rows), 64):
        part = rows[k : k + 64]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1].tobytes() for r in part], pa.binary()), pa.array([counts[np.searchsorted(words, r[1])].tobytes() for r in part], pa.binary()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64())],
            names=names,
        )


class _Known:
    """Scores of a unit's runs; those met before are in a table of fixed size."""

    def __init__(self, runs: np.ndarray, scores: np.ndarray) -> None:
        self.runs, self.scores = runs, scores
        self.keys = np.full(1 << _SLOTS, -1, np.int64)
        self.values = np.zeros(1 << _SLOTS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (mix(keys.view(np.uint64), 3) >> U64(64 - _SLOTS)).astype(np.int64)
        out = self.values[slot]
        new = np.flatnonzero(self.keys[slot] != keys)
        if len(new):
            distinct, where = np.unique(keys[new], return_inverse=True)
            scores = self.scores[np.searchsorted(self.runs, distinct)].astype(float)
            out[new] = scores[where]
            place = (mix(distinct.view(np.uint64), 3) >> U64(64 - _SLOTS)).astype(np.int64)
            self.keys[place] = distinct
            self.values[place] = scores
        return out


def _scored_runs(rows: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Rows (unit, context, runs, scores) of the runs of each unit of ``rows``, by the model of those not held out."""
    spark = rows.sparkSession
    split = min(SPLIT, depth)
    kinds = "unit long, context long, runs binary, counts binary"
    asked = durable(rows.select("unit", "held_out", "text").mapInArrow(_asked_runs(depth, split), kinds))
    model = durable(asked.repartition(buckets, "context").sortWithinPartitions("context").mapInArrow(_model(depth, split), f"{kinds}, key long, n long, up double"))
    release(spark)
    shared = spark.sparkContext.broadcast(_top(model, depth, split))  # at most 256^split symbols
    learned = model.filter("key is null").select("unit", "context", "runs", "counts")
    both = asked.unionByName(learned).repartition(buckets, "context").sortWithinPartitions("context", F.col("unit").asc_nulls_first())
    return both.mapInArrow(_run_answers(shared, depth, split), "unit long, context long, runs binary, scores binary")


def score(df: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    ``held_out``: which rows of ``df`` nothing is learned from. The model's score
    covers the bytes and the end symbol.
    """
    spark = df.sparkSession
    block = F.input_file_block_start()
    size = df.agg(F.sum(F.octet_length(text_col)).alias("n"), F.count_if(~F.coalesce(held_out, F.lit(False))).alias("ends")).first()
    # tasks hold a bounded share of the words, contexts and texts, whatever the session's partitions
    buckets, ends = parts_for(spark, size["n"] or 0), size["ends"]
    # rows of one file block are a unit; where rows come from no file, those of one hash of id and text
    unit = F.when(block >= 0, F.xxhash64(F.input_file_name(), block)).otherwise(F.pmod(F.xxhash64(id_col, text_col), F.lit(4 * buckets)))
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), unit.alias("unit"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = rows.select("unit", "held_out", "text").mapInArrow(_requests(buckets), "unit long, bucket long, words binary, counts binary")
    answers = durable(asked.repartition(buckets, "bucket").mapInArrow(_answers, "unit long, words binary, counts binary, distinct long, total long"))
    sums = answers.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    tokens, kinds = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    release(spark)
    scored = _scored_runs(rows, depth, buckets)
    bits, low = _low(depth, min(SPLIT, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = math.log10(tokens + 0.5 * (kinds + 1))
        unit, ready = None, False
        words: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        asked: list[np.ndarray] = []
        logs: list[np.ndarray] = []
        for batch in batches:
            give_back()
            units = batch.column("unit").to_numpy()
            cuts = np.flatnonzero(np.append(True, units[1:] != units[:-1])) if len(units) else []
            ends_at = [*cuts[1:], len(units)]
            # few rows at a time, as each step copies its rows
            steps = [(c, min(c + 1024, b)) for a, b in zip(cuts, ends_at, strict=True) for c in range(a, b, 1024)]
            for a, b in steps:
                part = batch.slice(a, b - a)
                if units[a] != unit:
                    unit, ready, words, counts, asked, logs, known = units[a], False, [], [], [], [], None
                answer = part.filter(pc.is_valid(part.column("words")))
                for w, c, x in zip(answer.column("words"), answer.column("counts"), answer.column("context").to_pylist(), strict=True):
                    if x is not None:
                        asked.append((x << bits) | np.frombuffer(w.as_buffer(), low).astype(np.int64))
                        logs.append(np.frombuffer(c.as_buffer(), np.float32))
                        continue
                    words.append(np.frombuffer(w.as_buffer(), np.uint64))
                    counts.append(np.frombuffer(c.as_buffer(), np.int64))
                docs = part.filter(pc.is_null(part.column("words")))
                if not docs.num_rows:
                    continue
                if not ready:
                    w = np.concatenate([*words, np.zeros(0, np.uint64)])
                    order = np.argsort(w)
                    table = w[order], np.concatenate([*counts, np.zeros(0, np.int64)])[order]
                    words, counts, ready = [], [], True
                    r = np.concatenate(asked)
                    order = np.argsort(r, kind="stable")
                    known = _Known(r[order], np.concatenate(logs)[order])
                    asked, logs, r, order = [], [], None, None
                for piece, buf, off in text_slices(iter([docs]), limit=_SLICE):
                    own, first = word_hashes(buf, off)
                    c = table[1][np.searchsorted(table[0], own)] if len(own) else np.zeros(0, np.int64)
                    ahead = np.append(0, np.cumsum(np.log10(c + 0.5) - base))
                    seen = np.append(0, np.cumsum(c > 0))
                    key, at = runs(buf, off, depth)
                    symbols = np.add.reduceat(known(key), at[:-1])
                    n = np.diff(first) + 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_id"),
                            piece.column("held_out"),
                            pa.array(n),
                            pa.array(seen[first[1:]] - seen[first[:-1]] + (ends > 0)),
                            pa.array(np.full(len(n), tokens, np.int64)),
                            pa.array(ahead[first[1:]] - ahead[first[:-1]] + math.log10(ends + 0.5) - base),
                            pa.array(symbols),
                            pa.array(np.diff(off)),
                            pa.array(-symbols / math.log10(2) / np.maximum(np.diff(off), 1)),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
                    )

    texts = rows.select("unit", "doc_id", "held_out", "text", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("long").alias("context"), F.lit(1).alias("part"))
    kind = df.schema[id_col].dataType.simpleString()
    none = [F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text")]
    sent = answers.filter("unit is not null").select("unit", *none, "words", "counts", F.lit(None).cast("long").alias("context"), F.lit(0).alias("part"))
    told = scored.select("unit", *none, F.col("runs").alias("words"), F.col("scores").alias("counts"), "context", F.lit(0).alias("part"))
    dealt = texts.unionByName(sent).unionByName(told).repartition(buckets, "unit").sortWithinPartitions("unit", "part", "context")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return dealt.select("unit", "doc_id", "held_out", "text", "words", "counts", "context").mapInArrow(run, schema)
