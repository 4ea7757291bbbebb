"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a run between line feeds) is hashed to a wide vector of 64-bit and
32-bit lanes; a text's fingerprint is the sum of its paragraphs' vectors, lane by
lane, modulo 2**64 and 2**32. So it doesn't depend on the order of paragraphs, and
``add`` and ``remove`` keep it up to date without the rest of the text.

* Eight 64-bit lanes come from a 512-bit BLAKE2b digest of the paragraph: they tell
  multisets of paragraphs apart.
* The 32-bit lanes hold the signed counts of the paragraph's runs of three words:
  the distance of two such sums estimates how much of the texts differs, which
  gives ``likeness``.

Defined results: null and empty text have the fingerprint of one empty paragraph;
ids may repeat or be null (null sorts first, ties go by the text's digest), and
columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomic.llm._bytes import buffers, shingle_hashes, word_hashes
from fathomic.llm._spark import bucket_of, partitions, parts_for, range_bounds, with_edges

LANES = 128
WIDTH = 3
_EXACT = 8


def _sketches(texts: list[bytes], lanes: int) -> np.ndarray:
    """Row sums of the paragraphs' signed 32-bit lanes; runs of words never cross a line feed."""
    lines = [t.split(b"\n") for t in texts]
    per = np.array([len(x) for x in lines])
    flat = [y for x in lines for y in x]
    off = np.append(0, np.cumsum([len(y) for y in flat]))
    buf = np.frombuffer(b"".join(flat), np.uint8)
    words, first = word_hashes(buf, off)
    grams, at = shingle_hashes(words, first, WIDTH)
    bounds = at[np.append(0, np.cumsum(per))]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    lane = (grams >> np.uint64(40)) % np.uint64(lanes)
    sign = ((grams & np.uint64(1)).astype(np.float64)) * 2 - 1
    total = np.bincount(row * lanes + lane.astype(np.int64), weights=sign, minlength=len(texts) * lanes)
    return total.reshape(len(texts), lanes).astype(np.int64)


def _exact(text: bytes) -> np.ndarray:
    digests = b"".join([hashlib.blake2b(p, digest_size=8 * _EXACT).digest() for p in text.split(b"\n")])
    return np.frombuffer(digests, "<u8").reshape(-1, _EXACT).sum(axis=0, dtype=np.uint64)


def vectors(texts: list[bytes], lanes: int = LANES) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two lane groups of each UTF-8 text."""
    if not texts:
        return []
    near = _sketches(texts, lanes)
    return [(_exact(t), near[i]) for i, t in enumerate(texts)]


def encode(vector: tuple[np.ndarray, np.ndarray]) -> str:
    exact, near = vector
    return exact.astype("<u8").tobytes().hex() + (near & 0xFFFFFFFF).astype("<u4").tobytes().hex()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    near = np.frombuffer(raw[8 * _EXACT :], "<u4").astype(np.uint32).view(np.int32).astype(np.int64)
    return np.frombuffer(raw[: 8 * _EXACT], "<u8"), near


def add(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after one more paragraph."""
    (a, b), (x, y) = decode(fingerprint), vectors([paragraph.encode()], (len(fingerprint) - 16 * _EXACT) // 8)[0]
    return encode((a + x, b + y))


def remove(fingerprint: str, paragraph: str) -> str:
    """The fingerprint without one occurrence of the paragraph."""
    (a, b), (x, y) = decode(fingerprint), vectors([paragraph.encode()], (len(fingerprint) - 16 * _EXACT) // 8)[0]
    return encode((a - x, b - y))


def likeness(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """The estimated cosine of two texts' run counts, within 0 to 1; 1 for equal fingerprints.

    Its standard error is about 1 / sqrt(lanes).
    """
    if np.array_equal(one[0], other[0]):
        return 1.0
    x, y = one[1].astype(np.float64), other[1].astype(np.float64)
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, (x @ y) / size))) if size else 0.0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES) -> DataFrame:
    """One row a document: id and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = buffers(b.column(1))
            raw = buf.tobytes()
            texts = [raw[off[i] : off[i + 1]] for i in range(len(off) - 1)]
            out = [encode(v) for k in range(0, len(texts), 512) for v in vectors(texts[k : k + 512], lanes)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _judge(batches: Iterator[pa.RecordBatch], lanes: int) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and order; the bucket's last row is the head of the next bucket."""
    held: tuple | None = None
    ready: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        # each text is hashed once for itself and used again as its predecessor's next
        own = vectors([x[1].encode() for x in ready], lanes)
        edits = [_edited(x[1], x[2]) for x in ready]
        changed = vectors([e.encode() for e in edits], lanes)
        last = vectors([ready[-1][2].encode()], lanes)
        following = [own[i + 1] if i + 1 < len(ready) and ready[i][3] else None for i in range(len(ready))]
        for i, v in enumerate(following):
            if v is None:
                following[i] = last[0] if i == len(ready) - 1 else vectors([ready[i][2].encode()], lanes)[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in ready]).cast(pa.int64()),
                pa.array([len(x[1]) for x in ready], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                pa.array([encode(v) for v in own], pa.string()),
                pa.array([encode(v) for v in changed], pa.string()),
                pa.array([likeness(v, w) for v, w in zip(own, changed, strict=True)], pa.float64()),
                pa.array([likeness(v, w) for v, w in zip(own, following, strict=True)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for doc, text, bucket, head in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "bucket", "_edge")), strict=True):
            text = text or ""
            if held is not None and held[2] == bucket:
                # True: the next row of the list is this row's next document
                ready.append((held[0], held[1], text, not head))
                size += len(held[1])
                if len(ready) >= 1024 or size >= 4 << 20:
                    ready[-1] = (*ready[-1][:3], False)
                    yield flush()
                    ready, size = [], 0
            held = None if head else (doc, text, bucket)
    if ready:
        yield flush()


def _tied_bucket(rows: DataFrame, count: int, total: int) -> F.Column:
    """The bucket of (doc_id, tie), by bounds from a sample of at most about 64 keys a bucket; only balance depends on them."""
    share = min(1.0, 64 * count / max(1, total))
    picked = rows.select("doc_id", "tie.a", "tie.n").filter(F.pmod(F.xxhash64("a", "n"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    found = sorted((tuple(r) for r in picked.collect()), key=lambda k: (k[0] is not None, k[0] or 0, *k[1:]))
    bounds = [found[k * len(found) // count] for k in range(1, count)] if len(found) > 1 else []
    key = F.struct("doc_id", F.struct("tie.a", "tie.n").alias("tie"))
    rank = F.lit(0)
    if bounds:
        every = F.array(*[F.struct(F.lit(i).cast("long").alias("doc_id"), F.struct(F.lit(a).alias("a"), F.lit(n).cast("long").alias("n")).alias("tie")) for i, a, n in sorted(set(bounds), key=lambda k: (k[0] is not None, k[0] or 0, *k[1:]))])
        rank = F.array_size(F.filter(every, lambda b: b <= key))
    return rank.cast("int")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES) -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, with their likeness.

    The edit replaces the last ``floor(n_chars / 4)`` code points by the first as many
    of the next document's text in ascending id (after the last: the first).

    Rows are cut into runs of ids of near equal counts, and each run carries the
    first row of the next, so no task orders the whole table.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    facts = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    count = max(4 * partitions(spark), parts_for(spark, facts["bytes"] or 0))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        bounds = range_bounds(rows, "doc_id", count)
        ordered, order = rows.withColumn("bucket", bucket_of(F.col("doc_id"), bounds, "bigint")), ["doc_id"]
    else:
        # ties: a digest of the text, then a number that makes equal rows distinct; bounds cut through ties too
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        ordered = rows.withColumn("tie", F.struct(digest.alias("a"), F.monotonically_increasing_id().alias("n")))
        order = ["doc_id", "tie"]
        ordered = ordered.withColumn("bucket", _tied_bucket(ordered, count, facts["n"]))
    whole = with_edges(ordered, "bucket", order, wrap=True)
    dealt = whole.repartition(max(partitions(spark), count // 4), "bucket").sortWithinPartitions("bucket", "_edge", *order)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "bucket", "_edge").mapInArrow(lambda it: _judge(it, lanes), schema)
