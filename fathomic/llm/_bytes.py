"""Vectorised text primitives over Arrow string columns.

Texts are handled as one UTF-8 byte buffer with row offsets, so hashing words
and shingles costs a few numpy passes a byte and no Python loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Byte classes: A-Z lower-cased; white space is \x20 and \x09-\x0D.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def give_back() -> None:
    """Return memory that a task has freed to the system; workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(4096)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ U64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0x9FB21C651E98DF25)
    return h ^ (h >> U64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of bounded bytes with the bytes and offsets of their text."""
    for batch in batches:
        buf, off = buffers(batch.column(text))
        for i, j in spans(off, limit):
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]
        del buf, off
        give_back()


def word_hashes(buf: np.ndarray, offsets: np.ndarray, strip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word and n + 1 word offsets of the rows.

    ``strip``: a table of bytes left out of words; a word of nothing else is no word.
    """
    n = len(buf)
    rows = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    word = ~SPACE[buf]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    begins[at] = word[at]
    starts = np.flatnonzero(begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = LOWER[buf]
    within = np.arange(n, dtype=np.int64)
    lengths = np.diff(np.append(starts, n))
    lead = starts[0]
    within[lead:] -= np.repeat(starts, lengths)
    longest = int(lengths.max())
    if strip is not None:
        kept = word & ~strip[buf]
        # the place in a word is the number of kept bytes before it
        seen = np.cumsum(kept)
        within[lead:] = seen[lead:] - 1 - np.repeat(seen[starts] - kept[starts], lengths)
        within[~kept] = 0
    else:
        kept = word
    powers = _POW if longest < len(_POW) else _powers(longest + 1)
    each = (low.astype(np.uint64) + U64(1)) * powers[within]
    each[~kept] = 0
    hashes = mix(np.add.reduceat(each, starts))
    first = np.searchsorted(starts, offsets)
    if strip is not None:
        full = np.add.reduceat(kept.astype(np.int64), starts) > 0
        hashes = hashes[full]
        first = np.append(0, np.cumsum(full))[first]
    return hashes, first.astype(np.int64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``width`` words, repeats kept, and n + 1 offsets.

    ``whole``: a row of fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    number = np.maximum(counts - width + 1, 0)
    if whole:
        number = np.where((counts > 0) & (counts < width), 1, number)
    out = np.append(0, np.cumsum(number))
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    row = np.repeat(np.arange(len(counts)), number)
    at = np.arange(out[-1]) - out[row] + first[row]
    end = first[row + 1]
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        there = at + k < end
        total = total * U64(0xC2B2AE3D27D4EB4F) + np.where(there, words[np.minimum(at + k, len(words) - 1)], U64(k + 1))
    return mix(total, width), out
