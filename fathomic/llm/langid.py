"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte runs of two to four
letters (A-Z lower-cased, letters and word edges only); a linear layer and a softmax give
the languages' probabilities. Embeddings and layer are trained together by stochastic
gradient descent in numpy, on a bounded sample of labelled rows. A temperature fitted on
held-back labelled rows calibrates the probability, and ``reject_below`` is the
probability under which a text's language counts as unknown.

Since the layer is linear, a run's embedding times the layer is one row of a table, and
prediction is a mean of table rows over the whole text.

Defined results: text that is null or has no letter gets ``und`` with score 0, as does
every text if there is nothing to learn from. Rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomic.llm._bytes import LOWER, U64, buffers, give_back, mix, spans

UNKNOWN = "und"
#: At most so many labelled rows of each language train the classifier, chosen by a hash of the id.
SAMPLE = 1500
BUCKETS = 1 << 16
DIM = 16
REJECT_BELOW = 0.5
_ORDERS = (2, 3, 4)

# Bytes that stand for letters: A-Z, a-z and every byte of a longer code point.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def features(buf: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all runs and the row of each; runs touch a letter and cross no row."""
    low = np.where(_LETTER[buf], LOWER[buf], np.uint8(32)).astype(np.uint64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    letter = low != 32
    ids, rows = [], []
    for n in _ORDERS:
        if len(low) < n:
            continue
        key = np.zeros(len(low) - n + 1, np.uint64)
        any_letter = np.zeros(len(key), bool)
        inner = np.ones(len(key), bool)
        for k in range(n):
            part = slice(k, len(low) - n + 1 + k)
            key = key * U64(256) + low[part]
            any_letter |= letter[part]
            if 0 < k < n - 1:
                inner &= letter[part]
        ok = any_letter & inner & (row[: len(key)] == row[n - 1 :])
        ids.append((mix(key[ok], n) % U64(buckets)).astype(np.int32))
        rows.append(row[: len(key)][ok])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(rows)


def bag_of(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their shares, which sum to one; at most ``buckets`` of them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    found, _ = features(raw, np.array([0, len(raw)]), buckets)
    own, count = np.unique(found, return_counts=True)
    return own.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], buckets: int = BUCKETS, dim: int = DIM, epochs: int = 8, least_steps: int = 600, rate: float = 2.0, batch: int = 32, reject_below: float = REJECT_BELOW, seed: int = 7) -> Model:
    """Train on nine tenths of the rows and calibrate on the rest."""
    labels = tuple(sorted(set(langs)))
    rng = np.random.default_rng(seed)
    y = np.array([labels.index(x) for x in langs])
    starts = np.append(0, np.cumsum([len(i) for i, _ in bags]))
    ids, shares = np.concatenate([i for i, _ in bags]).astype(np.int64), np.concatenate([x for _, x in bags])
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, len(labels)))
    bias = np.zeros(len(labels))
    order = rng.permutation(len(y))
    held = order[: len(y) // 10]
    train = order[len(y) // 10 :]

    def bag(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of some texts, and the texts' shares of each."""
        sizes = starts[rows + 1] - starts[rows]
        at = np.repeat(starts[rows] - np.append(0, np.cumsum(sizes))[:-1], sizes) + np.arange(sizes.sum())
        own, column = np.unique(ids[at], return_inverse=True)
        x = np.zeros((len(rows), len(own)), np.float32)
        x[np.repeat(np.arange(len(rows)), sizes), column] = shares[at]
        return own, x

    # few texts go round more often, so that every model gets about as many steps at least
    epochs = max(epochs, -(-least_steps * batch // max(1, len(train))))
    steps = max(1, epochs * -(-len(train) // batch))
    done = 0
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), batch):
            rows = train[k : k + batch]
            own, x = bag(rows)
            hidden = x @ emb[own]
            p = _softmax(hidden @ out + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            step = rate * (1 - done / steps)
            # embeddings get the larger step, as each meets few of the texts
            back = 8 * step * (p @ out.T)
            out -= step * hidden.T @ p
            bias -= step * p.sum(axis=0)
            emb[own] -= x.T @ back.astype(np.float32)
            done += 1
    temperature = 1.0
    if len(held) >= 10:
        logits = np.concatenate([(lambda own, x: x @ emb[own])(*bag(held[k : k + batch])) for k in range(0, len(held), batch)]) @ out + bias
        best = None
        for t in np.geomspace(0.05, 5, 60):
            loss = -np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
            if best is None or loss < best[0] - 1e-9:
                best = (loss, float(t))
        temperature = best[1]
    return Model(labels, (emb @ out).astype(np.float32), bias, temperature, reject_below)


def probabilities(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Calibrated probabilities of each row, all zero where no run was found."""
    ids, rows = features(buf, off, len(model.table))
    n = len(off) - 1
    count = np.bincount(rows, minlength=n)
    logits = np.stack([np.bincount(rows, weights=model.table[ids, k], minlength=n) for k in range(len(model.labels))], axis=1)
    logits = logits / np.maximum(count, 1)[:, None] + model.bias
    return np.where((count > 0)[:, None], _softmax(logits / model.temperature), 0)


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, among: Column | None = None) -> Model | None:
    """Fit on at most ``sample`` rows of each language, the least by a hash of the id; None without rows.

    Texts stay on the executors: one of them gets the chosen texts' bags of buckets,
    whose size doesn't grow with the texts, and trains on them.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if among is not None:
        rows = rows.filter(among)
    key = F.xxhash64("id", F.lit("langid"))
    # the hash below which a language has about twice the sample, from counts alone
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * sample / n + 50 / n))]), F.col("lang"))
    near = rows.filter(F.pmod(key, F.lit(1 << 30)) <= share * (1 << 30)).withColumn("key", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [bag_of(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("lang"), pa.array([i.tobytes() for i, _ in bags], pa.binary()), pa.array([x.tobytes() for _, x in bags], pa.binary())], names=["key", "lang", "ids", "shares"])

    # all languages in one pass over the rows near the least hashes, about twice the sample each
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= sample).select("key", "lang", "text")
    bags = chosen.mapInArrow(run, "key long, lang string, ids binary, shares binary")
    # one task trains: the sample is bounded, and the driver gets the model alone
    return pickle.loads(bags.repartition(1).mapInArrow(_train, "model binary").first()["model"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    taken = sorted((r["key"], r["lang"], r["ids"], r["shares"]) for b in batches for r in b.to_pylist())
    if taken:
        model = fit([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for _, _, i, x in taken], [lang for _, lang, _, _ in taken])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
    del taken
    give_back()


def judge(m: Model | None, text: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    """The language of each text, its calibrated probability, and whether it is rejected."""
    if m is None:
        return [UNKNOWN] * len(text), [0.0] * len(text), [True] * len(text)
    buf, off = buffers(text)
    lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names, scores = [], []
    for i, j in spans(off, 1 << 19):
        p = probabilities(m, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        for k in range(j - i):
            good = lettered[i + k]
            # a letter outside runs leaves the prior
            row = p[k] if p[k].any() else np.full(len(m.labels), 1 / len(m.labels))
            names.append(m.labels[int(row.argmax())] if good else UNKNOWN)
            scores.append(float(min(1.0, row.max())) if good else 0.0)
    return names, scores, [n == UNKNOWN or s < m.reject_below for n, s in zip(names, scores, strict=True)]


def predict(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with lang_pred, score (the calibrated probability) and rejected, which replace columns of these names."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the input
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, rejected = judge(shared.value, b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*b.schema.names[:-1], "lang_pred", "score", "rejected"],
            )
            give_back()

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    rows = df.select(*keep, F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, rejected boolean"]))


def keep_known(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that aren't rejected, with all their columns, whatever their names."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, rejected = judge(shared.value, b.column(text_col))
            yield b.filter(pa.array([not r for r in rejected], pa.bool_()))
            give_back()

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id", fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == fold, F.lit(False))
