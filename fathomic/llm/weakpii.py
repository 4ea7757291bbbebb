"""Personal data by weak supervision.

Candidates are all forms that might be personal data, whether the base patterns take them
or not: addresses spelled out or without a domain's dot, dotted quads, long runs of digits,
groups of digits. Labelers of three sorts (patterns and checksums, gazetteers, words in
context) vote on each. Expectation-maximisation over the counts of vote patterns of the
whole corpus estimates how reliable each labeler is; base spans are known positives, all
other candidates are unlabelled, and most of them are what they only look like (dates, numbers
of orders, books and versions). The posteriors train a logistic span classifier on votes and
on features that no labeler has (separators, length, other kinds' words nearby), which decides
on every candidate that the base patterns don't already give.

Base spans (email, ip, card, phone) are always kept; the method adds spans that overlap
none of them.

Patterns of votes and features are few, so their counts are all that the driver gets, and
training doesn't grow with the corpus.

Defined results: null counts as empty text and has no spans; rows may repeat; other
columns are ignored; of overlapping candidates that are accepted the first counts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, so saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Candidates beyond the base patterns; each has bounded repeats, so a scan is linear.
_SPELLED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
_WORDED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63}){1,4}(?![\w-])", re.IGNORECASE)
_DOTLESS = re.compile(r"(?<![\w.%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?![\w.@-])")
_QUAD = re.compile(r"(?<![\w.])[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,4}){3,5}(?![\w])")
_SIX = re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])")
_PLAIN_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![\w-])")
_GROUPS = re.compile(r"(?<![\w+.,/-])\(?[0-9]{2,6}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,5}(?![\w-])")
_CARD_PART = re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])")
_LONG_NUMBER = re.compile(r"(?<![\w.,-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")

# Gazetteers and context words.
_TOP = frozenset("com org net edu gov mil int io co me ai app dev info biz name de fr es it uk eu nl be ch at se no dk fi pl pt cz ru ua jp cn kr in au nz ca us br mx ar cl za".split())
_ISSUERS = tuple("34 37 30 36 38 4 51 52 53 54 55 22 23 24 25 26 27 6011 64 65 35 50 56 57 58 62".split())
_CONTEXT = {
    "email": re.compile(r"mail|contact|write|schreib|écri|correo", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|adres", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|fax|mobile|handy|llam|appel", re.IGNORECASE),
}
_AGAINST = re.compile(r"version|licen[cs]e|isbn|serial|order|invoice|release|\bid\b|\bno\.|\bpage|\bdate", re.IGNORECASE)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[ -]{1,2}(?:19|20)[0-9]{2}")
_SEPARATORS = (" ", "-", ".", "/")
_AROUND = 40
#: How many values each trait has.
_TRAITS = (6, 5, 2, 2, 2, 2, 2)
LABELERS = ("shape", "checksum", "gazetteer", "context", "edges")
ACCEPT = 0.9
#: Where EM starts: how often each labeler votes -1, 0 and 1 on personal data, and on what only looks like it.
_START = np.array(
    [
        [(0.40, 0.30, 0.30), (0.10, 0.30, 0.60)],  # shape
        [(0.60, 0.30, 0.10), (0.02, 0.28, 0.70)],  # checksum
        [(0.50, 0.30, 0.20), (0.10, 0.30, 0.60)],  # gazetteer
        [(0.35, 0.50, 0.15), (0.05, 0.45, 0.50)],  # context
        [(0.30, 0.10, 0.60), (0.10, 0.10, 0.80)],  # edges
    ]
)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, each found from its @, so that long runs of name characters cost once."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then by start."""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def extra_candidates(text: str, base: list[Span]) -> list[Span]:
    """Candidates that overlap no base span, by start; of one kind none lies in another."""
    out: list[Span] = []

    def take(kind: str, pattern: re.Pattern) -> None:
        out.extend((kind, m.start(), m.end()) for m in pattern.finditer(text))

    if "@" in text:
        take("email", _DOTLESS)
    low = text.lower() if "at" in text or "AT" in text else ""
    if re.search(r"[\[({]\s?at\s?[\])}]", low):
        take("email", _SPELLED)
    if " at " in low and " dot " in low:
        take("email", _WORDED)
    if ":" in text:
        take("ip", _SIX)
    if _DIGIT.search(text):
        take("ip", _QUAD)
        take("card", _LONG_NUMBER)
        out.extend(("card", m.start(), m.end()) for m in _CARD_PART.finditer(text) if luhn(_NOT_DIGIT.sub("", m.group())))
        take("phone", _PLAIN_PHONE)
        take("phone", _GROUPS)
    if not out:
        return out
    # stretches that base spans cover, joined where they overlap
    starts, ends = [], []
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    kept: list[Span] = []
    last: dict[str, int] = {}
    for kind, s, e in sorted(set(out), key=lambda x: (x[1], -x[2], x[0])):
        k = bisect_left(starts, e)
        if (k and ends[k - 1] > s) or s < last.get(kind, 0):
            continue
        last[kind] = e
        kept.append((kind, s, e))
    return kept


def _isbn(digits: str) -> bool:
    if len(digits) == 13 and digits[:3] in ("978", "979"):
        return sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(digits)) % 10 == 0
    return len(digits) == 10 and sum(int(d) * (10 - k) for k, d in enumerate(digits)) % 11 == 0


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote of -1, 0 or 1 from each of ``LABELERS``."""
    kind, start, end = span
    body = text[start:end]
    digits = _NOT_DIGIT.sub("", body)
    around = text[max(0, start - _AROUND) : start] + " " + text[end : end + _AROUND]
    shape, checksum, gazetteer = {"email": _email_votes, "ip": _ip_votes, "card": _card_votes, "phone": _phone_votes}[kind](body, digits)
    context = 1 if _CONTEXT[kind].search(around) else -1 if _AGAINST.search(around) else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    edges = -1 if before.isalnum() or after.isalnum() else 1
    return shape, checksum, gazetteer, context, edges


def _email_votes(body: str, digits: str) -> tuple[int, int, int]:
    labels = [x for x in re.split(r"[^A-Za-z0-9-]+|(?i:\bdot\b)", re.split(r"@|(?i:\bat\b)", body)[-1]) if x]
    sound = len(labels) > 1 and all(x[0] != "-" and x[-1] != "-" for x in labels) and re.fullmatch(r"[A-Za-z]{2,}", labels[-1])
    return 1 if "@" in body or re.search(r"[\[({]", body) else 0, 1 if sound else -1, 1 if labels and labels[-1].lower() in _TOP and len(labels) > 1 else -1


def _ip_votes(body: str, digits: str) -> tuple[int, int, int]:
    if ":" in body:
        return 1, 1, 1 if body[0] in "23fF" else 0
    parts = re.split(r"[^0-9]+", body.strip("[]()."))
    sound = len(parts) == 4 and all(int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts)
    return 1 if len(parts) == 4 else -1, 1 if sound else -1, 1 if parts[0] in ("10", "127", "172", "192") else -1 if parts[0] in ("0", "1", "2", "3") else 0


def _card_votes(body: str, digits: str) -> tuple[int, int, int]:
    groups = [len(x) for x in re.split(r"[^0-9]+", body)]
    shape = 1 if groups in ([4, 4, 4, 4], [4, 6, 5], [16], [15]) else 0 if len(groups) == 1 else -1
    return shape, 1 if luhn(digits) else -1, 1 if digits.startswith(_ISSUERS) else -1


def _phone_votes(body: str, digits: str) -> tuple[int, int, int]:
    groups = [len(x) for x in re.split(r"[^0-9]+", body.strip("+()"))]
    if body[0] == "+" or (groups == [3, 3, 4] and len(re.findall(r"[^0-9]+", body)) <= 3):
        shape = 1
    else:
        shape = -1 if _DATE.fullmatch(body) or "/" in body or len(groups) < 3 else 0
    checksum = 1 if 8 <= len(digits) <= 15 and len(set(digits)) > 2 and not _isbn(digits) else -1
    # area and exchange codes of the northern American plan, and trunk zeros elsewhere
    known = body[0] == "+" or (len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789")
    return shape, checksum, 1 if known else 0 if digits[:1] == "0" and digits[1:2] != "0" else -1


def traits(text: str, span: Span) -> tuple[int, ...]:
    """What the classifier sees beside the votes: separators, length, and words of each kind nearby, as small numbers."""
    _, start, end = span
    body = text[start:end]
    around = text[max(0, start - _AROUND) : start] + " " + text[end : end + _AROUND]
    used = [x in body for x in _SEPARATORS]
    separators = 0 if not any(used) else 5 if sum(used) > 1 else 1 + used.index(True)
    length = min(4, sum(c.isdigit() for c in body) // 4)
    return separators, length, *(int(_CONTEXT[k].search(around) is not None) for k in KINDS), int(_AGAINST.search(around) is not None)


@dataclass(frozen=True)
class Model:
    reliability: dict[str, np.ndarray]  # of a kind: P(vote | class), labelers x classes x votes
    weights: dict[str, np.ndarray]


def _one_hot(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Columns of votes, and of each value that a trait may have."""
    known = [(t[:, k] == x).astype(float)[:, None] if t.shape[1] else np.zeros((len(v), 1)) for k, n in enumerate(_TRAITS) for x in range(1, n)]
    return np.concatenate([np.ones((len(v), 1)), *[(v == x).astype(float) for x in (-1, 1)], *known], axis=1)


def fit(patterns: list[tuple], rounds: int = 50) -> Model:
    """``patterns``: kind, whether base, votes, count and, if seen, traits. Base spans are known to be positive.

    EM sees every candidate of the corpus through the counts.
    """
    reliability, weights = {}, {}
    for kind in KINDS:
        own = [p for p in patterns if p[0] == kind]
        k = len(LABELERS)
        prob = _START.copy()
        if not own:
            continue
        v = np.array([p[2] for p in own])
        n = np.array([p[3] for p in own], float)
        base = np.array([p[1] for p in own])
        prior = 0.5
        post = np.where(base, 1.0, 0.5)
        for _ in range(rounds):
            up = np.log(prior) + sum(np.log(prob[j, 1, v[:, j] + 1]) for j in range(k))
            down = np.log(1 - prior) + sum(np.log(prob[j, 0, v[:, j] + 1]) for j in range(k))
            post = np.where(base, 1.0, 1 / (1 + np.exp(np.clip(down - up, -500, 500))))
            free = n * ~base
            prior = float(np.clip((free @ post + 1) / (free.sum() + 2), 0.01, 0.99))
            for c, share in ((1, post), (0, 1 - post)):
                w = n * share
                # ten pseudo-votes hold a labeler near its start where little was seen
                for j in range(k):
                    seen = np.array([w[v[:, j] == x].sum() for x in (-1, 0, 1)]) + 10 * _START[j, c]
                    prob[j, c] = seen / seen.sum()
        reliability[kind] = prob
        x = _one_hot(v, np.array([p[4] if len(p) > 4 else () for p in own], int).reshape(len(own), -1))
        w = np.zeros(x.shape[1])
        mass = n / n.sum()
        for _ in range(2000):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 2.0 * (x.T @ (mass * (p - post)) + 1e-4 * w)
        weights[kind] = w
    return Model(reliability, weights)


def accepts(model: Model, kind: str, v: tuple[int, ...], t: tuple[int, ...] = ()) -> bool:
    w = model.weights.get(kind)
    return w is not None and 1 / (1 + np.exp(-float((_one_hot(np.array([v]), np.array([t], int).reshape(1, -1)) @ w)[0]))) >= ACCEPT


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, int] = {}
    for b in batches:
        for text in b.column(0):
            text = text.as_py() or ""
            base = base_spans(text)
            for spans, flag in ((base, True), (extra_candidates(text, base), False)):
                for s in spans:
                    key = (s[0], flag, ",".join(map(str, votes(text, s))), ",".join(map(str, traits(text, s))))
                    counts[key] = counts.get(key, 0) + 1
    keys = sorted(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.string()), pa.array([k[3] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
        names=["kind", "base", "votes", "traits", "n"],
    )


def learn(df: DataFrame, text_col: str = "text") -> Model:
    """Count vote patterns over every text and fit the model on the counts."""
    rows = df.select(F.col(text_col).alias("text")).mapInArrow(_patterns, "kind string, base boolean, votes string, traits string, n long")
    found = rows.groupBy("kind", "base", "votes", "traits").agg(F.sum("n").alias("n")).collect()
    numbers = lambda x: tuple(map(int, x.split(",")))
    return fit(sorted((r["kind"], r["base"], numbers(r["votes"]), r["n"], numbers(r["traits"])) for r in found))


def all_spans(text: str, model: Model, cache: dict) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind as listed, then by start; added spans don't overlap."""
    base = base_spans(text)
    added: list[Span] = []
    end = 0
    for c in extra_candidates(text, base):
        if c[1] < end:
            continue
        key = (c[0], votes(text, c), traits(text, c))
        if key not in cache:
            cache[key] = accepts(model, *key)
        if cache[key]:
            added.append(c)
            end = c[2]
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (rank[s[0]], s[1], s[2])) if added else base


def _joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_email, n_ip, n_card, n_phone, base_sha256 and spans; counts are of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, joined = [], []
            for text in b.column(1):
                text = text.as_py() or ""
                base, spans = all_spans(text, model, cache)
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(joined, pa.string())],
                names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(df: DataFrame, model: Model, text_col: str = "text", n_chars: str | None = None) -> DataFrame:
    """``df`` with every span in ``text_col`` replaced by its kind in brackets; null stays null.

    ``n_chars``: a column that is to follow the length of changed texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            at = b.schema.get_field_index(text_col)
            out = []
            sizes = b.column(n_chars).to_pylist() if n_chars else []
            for k, text in enumerate(b.column(at)):
                text = text.as_py()
                if text is not None:
                    _, spans = all_spans(text, model, cache)
                    if spans:
                        parts, done = [], 0
                        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                            if e > done:
                                parts += [text[done : max(done, s)], f"[{kind.upper()}]"] if s >= done else []
                                done = e
                        text = "".join([*parts, text[done:]])
                        if n_chars:
                            sizes[k] = len(text)
                out.append(text)
            b = b.set_column(at, text_col, pa.array(out, pa.string()))
            if n_chars:
                place = b.schema.get_field_index(n_chars)
                b = b.set_column(place, n_chars, pa.array(sizes, b.column(place).type))
            yield b

    return df.mapInArrow(run, df.schema)
