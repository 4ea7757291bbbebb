"""Benchmark decontamination by greedy string tiling.

Runs of ``least`` words shared with a benchmark item are seeds, found by Karp-Rabin
hashes of every run of a document. Seeds on one diagonal join to maximal matches; the
longest match that touches no marked word is marked as a tile, again and again, so
passages count wherever and in whatever order they stand. A document is contaminated by an
item if tiles of ``least`` words or more cover at least ``threshold`` of its words; an
item of fewer words must occur whole.

Words are lower-cased (A-Z) and stripped of ASCII punctuation.

The benchmark is a stated set: it is used in blocks of bounded bytes, each sent to the
executors and held against all documents, so no document is shuffled. A task reads its
documents once and holds a bounded slice of them against one block after the other.

Tiles never cover more of an item than its shared seeds do, so two bounds come before any
tiling. An item can be contaminated only if at least a given number of its seeds are shared; it
is looked up by all but one fewer of them, the most frequent of the benchmark left out, so a
stock phrase of many items finds none of them by itself. What is found must have enough words under shared seeds.

Defined results: null and empty texts match nothing, nor do items without a word;
repeated rows give a row each; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomic.llm._bytes import buffers, shingle_hashes, text_slices, word_hashes

LEAST = 5
THRESHOLD = 0.8
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 16 << 20
#: Bytes of benchmark text that one pass over the documents is sent.
PASS_BYTES = 256 << 20
#: Bytes of documents that are held against one block after the other.
SLICE_BYTES = 16 << 20

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(buf, off, strip=_PUNCTUATION)


def tile(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length) from seed pairs, longest first.

    Ties go to the earlier place in the item, then in the document.
    """
    order = np.lexsort((at_item, at_doc - at_item))
    i, d = at_item[order], at_doc[order]
    begins = np.ones(len(i), bool)
    begins[1:] = (np.diff(i) != 1) | (np.diff(d) != 1)
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(i))) + least - 1
    matches = [(int(n), int(i[s]), int(d[s])) for s, n in zip(starts, sizes, strict=True)]
    used_item = np.zeros(len(item), bool)
    used_doc: set[int] = set()
    tiles = []
    while matches:
        matches.sort(key=lambda m: (-m[0], m[1], m[2]))
        n, a, b = matches.pop(0)
        tiles.append((a, b, n))
        used_item[a : a + n] = True
        used_doc.update(range(b, b + n))
        rest = []
        for size, x, y in matches:
            # what a tile left of a match is a shorter match, or two
            run = 0
            for k in range(size + 1):
                if k < size and not used_item[x + k] and (y + k) not in used_doc:
                    run += 1
                    continue
                if run >= least:
                    rest.append((run, x + k - run, y + k - run))
                run = 0
        matches = rest
        if used_item.all():
            break
    return tiles


class Block:
    """Benchmark items, looked up by the rarer of their seeds. Equal items are one, with several ids."""

    def __init__(self, ids: list, texts: list[str], least: int, threshold: float) -> None:
        buf, off = buffers(pa.array(texts, pa.string()))
        words, first = words_of(buf, off)
        places: dict[bytes, int] = {}
        self.ids: list[list] = []
        self.items: list[np.ndarray] = []
        for k, own in enumerate(ids):
            item = words[first[k] : first[k + 1]]
            if len(item) and places.setdefault(item.tobytes(), len(self.items)) == len(self.items):
                self.items.append(item)
                self.ids.append([])
            if len(item):
                self.ids[places[item.tobytes()]].append(own)
        sizes = np.array([len(x) for x in self.items], np.int64)
        #: Words that have to be covered.
        self.wanted = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
        self.seeds: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(self.items)
        self.tables = []
        # a short item is one seed of its own width
        for width in sorted({min(least, int(n)) for n in sizes}):
            chosen = np.flatnonzero(sizes >= least) if width == least else np.flatnonzero(sizes == width)
            for k in chosen:
                self.seeds[k], _ = shingle_hashes(self.items[k], np.array([0, sizes[k]]), width, whole=False)
            h = np.concatenate([self.seeds[k] for k in chosen])
            item = np.repeat(chosen, [len(self.seeds[k]) for k in chosen])
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            # an item's seeds by how often the benchmark has them
            order = np.lexsort((h, count[which], item))
            rank = np.arange(len(h)) - np.repeat(np.searchsorted(item, chosen), [len(self.seeds[k]) for k in chosen])
            number = np.array([len(self.seeds[k]) for k in chosen])
            kept = number - -(-self.wanted[chosen] // width) + 1
            keep = order[rank < np.repeat(kept, number)]
            keep = keep[np.lexsort((item[keep], h[keep]))]
            self.tables.append((width, h[keep], item[keep]))

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(row, item, width, tiles) of every row and item with enough words under shared seeds."""
        for width, index, items in self.tables:
            grams, at = shingle_hashes(words, first, width, whole=False)
            lo = np.searchsorted(index, grams)
            found = np.flatnonzero(index[np.minimum(lo, len(index) - 1)] == grams)
            if len(found) == 0:
                continue
            row = np.searchsorted(at, found, side="right") - 1
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            for s, e in zip(starts, np.append(starts[1:], len(row)), strict=True):
                r = int(row[s])
                keys = np.unique(grams[found[s:e]])
                a, b = np.searchsorted(index, keys), np.searchsorted(index, keys, side="right")
                ks = np.unique(np.concatenate([items[x:y] for x, y in zip(a, b, strict=True)]))
                doc = grams[at[r] : at[r + 1]]
                order = np.argsort(doc, kind="stable")
                ordered = doc[order]
                seeds = np.concatenate([self.seeds[k] for k in ks])
                owner = np.repeat(np.arange(len(ks)), [len(self.seeds[k]) for k in ks])
                left = np.searchsorted(ordered, seeds)
                shared = np.flatnonzero(ordered[np.minimum(left, len(ordered) - 1)] == seeds)
                gap = np.full(len(shared), width)
                same = owner[shared[1:]] == owner[shared[:-1]]
                gap[:-1][same] = np.minimum(np.diff(shared)[same], width)
                covered = np.bincount(owner[shared], weights=gap, minlength=len(ks))
                begin = np.searchsorted(owner, np.arange(len(ks) + 1))
                for x in np.flatnonzero(covered >= self.wanted[ks]):
                    k = int(ks[x])
                    own = shared[np.searchsorted(shared, begin[x]) : np.searchsorted(shared, begin[x + 1])]
                    count = np.searchsorted(ordered, seeds[own], side="right") - left[own]
                    at_doc = order[np.repeat(left[own] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(count.sum())]
                    yield r, k, width, tile(self.items[k], words[first[r] : first[r + 1]], np.repeat(own - begin[x], count), at_doc, width)


def _held(batches: Iterator[pa.RecordBatch], text: str, several: bool) -> Iterator[list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    """Slices of rows with their words; more of them at a time where there are several blocks."""
    held, size = [], 0
    for part, buf, off in text_slices(batches, text):
        held.append((part, *words_of(buf, off)))
        size += len(buf)
        if not several or size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _built(shared, least: int, threshold: float) -> Callable[[], Iterator[Block]]:
    """The blocks of a broadcast, one at a time; a single one is built once a task."""
    blocks = shared.value
    if len(blocks) == 1:
        one = Block(*blocks[0], least, threshold)
        return lambda: iter((one,))
    return lambda: (Block(*b, least, threshold) for b in blocks)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns doc_id, item_id, n_words (of the item), covered, coverage, n_tiles; a row for each contaminated pair."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = (df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words long, covered long, coverage double, n_tiles long"
    out = spark.createDataFrame([], schema)
    for blocks in _passes(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), block_bytes):
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            built = _built(shared, least, threshold)
            for held in _held(batches, "text", len(shared.value) > 1):
                for block in built():
                    for part, words, first in held:
                        docs = part.column(0)
                        found = []
                        for r, k, _, tiles in block.hits(words, first):
                            covered, size = sum(n for _, _, n in tiles), len(block.items[k])
                            if covered >= block.wanted[k]:
                                found += [(docs[r], i, size, covered, covered / size, len(tiles)) for i in block.ids[k]]
                        if found:
                            d, i, *rest = zip(*found, strict=True)
                            arrays = [pa.array([x.as_py() for x in d]).cast(docs.type), pa.array(i), *[pa.array(x) for x in rest]]
                            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "n_words", "covered", "coverage", "n_tiles"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def _passes(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[list, list[str]]]]:
    """Blocks of the benchmark, as many at a time as a pass over the documents takes."""
    held: list = []
    size = 0
    for ids, texts, n in _blocks(items, block_bytes):
        if held and size + n > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((ids, texts))
        size += n
    if held:
        yield held


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[str], int]]:
    """The benchmark a bounded number of bytes at a time, with that number."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for r in items.filter(F.col("text").isNotNull()).toLocalIterator():
        own = len(r["text"].encode())
        if texts and size + own > block_bytes:
            yield ids, texts, size
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += own
    if texts:
        yield ids, texts, size


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` that no item contaminates, with all their columns; rows stay where they are."""
    for blocks in _passes(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), block_bytes):
        shared = df.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            built = _built(shared, least, threshold)
            for held in _held(batches, text_col, len(shared.value) > 1):
                kept = [np.ones(part.num_rows, bool) for part, _, _ in held]
                for block in built():
                    for (_, words, first), keep in zip(held, kept, strict=True):
                        for r, k, _, tiles in block.hits(words, first):
                            if sum(n for _, _, n in tiles) >= block.wanted[k]:
                                keep[r] = False
                for (part, _, _), keep in zip(held, kept, strict=True):
                    yield part if keep.all() else part.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df
