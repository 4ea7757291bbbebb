"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The automaton holds every ordinary piece of a model; one pass over a text follows its
output links, so each position meets the pieces that end there and keeps the best score
to it. A character that no piece reaches costs less than any piece and is written as
byte pieces, so every text decodes to itself.

A model of the unigram kind stores log probabilities. One of the BPE kind stores merge
ranks, whose sums mean nothing; there a piece of rank r scores as Zipf's law has it,
``-log(r + 2)``, which keeps the model's order of pieces.

Pieces have no space after another character, and none joins a line feed to anything
(both are checked when a model is loaded), so the best path of a text is the best paths
of its units one after the other; paths of units seen before are kept in a bounded table.

Defined results: null and empty texts have no tokens and decode to the empty text; a
literal word mark (U+2581) is written as bytes. Rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Units whose paths are remembered at once; the table is emptied when it is full.
REMEMBERED = 800_000
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


class Pieces:
    """A model's pieces with their automaton."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.normalization_rule_tsv or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("the model normalizes texts, which would not decode to themselves; only identity with a leading space is encoded")
        ranked = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton = ahocorasick.Automaton()
        self.bytes: list[int] = [-1] * 256
        self.raw: list[bytes] = []
        singles = set()
        scores = []
        crossing = newline = False
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.raw.append(bytes([value]))
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or not piece:
                self.raw.append(b"")
                continue
            self.raw.append(piece.replace(MARK, " ").encode())
            score = -math.log(2 - sp.get_score(i)) if ranked else sp.get_score(i)
            scores.append(score)
            self.automaton.add_word(piece, (len(piece), score, i))
            crossing |= re.search(f"[^{MARK}]{MARK}", piece) is not None
            newline |= len(piece) > 1 and "\n" in piece
            if len(piece) == 1:
                singles.add(piece)
        if -1 in self.bytes:
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        self.automaton.make_automaton()
        self.singles = singles
        self.unknown = min(scores, default=0.0) - 10
        self.units = re.compile(r" +[^ \n]*|\n|[^ \n]+" if not newline else r" +[^ ]*|[^ ]+") if not crossing else re.compile(r"(?s).+")
        self.seen: dict[str, bytes] = {}

    def path(self, unit: str) -> bytes:
        """Ids of the best path, as 32-bit numbers; of equal scores the longer last piece wins."""
        # marks of the text itself must not meet the pieces' marks
        text = unit.replace(MARK, "\0").replace(" ", MARK)
        n = len(text)
        best = [0.0] + [-1e300] * n
        starts, pieces = [0] * (n + 1), [-1] * (n + 1)
        singles = self.singles
        bare = [k for k in range(n) if text[k] not in singles]
        waiting = 0
        for end, (size, score, piece) in self.automaton.iter(text):
            while waiting < len(bare) and bare[waiting] < end:
                self._bare(bare[waiting], best, starts, pieces)
                waiting += 1
            start = end + 1 - size
            score += best[start]
            if score > best[end + 1]:
                best[end + 1] = score
                starts[end + 1] = start
                pieces[end + 1] = piece
        for k in bare[waiting:]:
            self._bare(k, best, starts, pieces)
        out: list[int] = []
        at = n
        while at:
            start = starts[at]
            if pieces[at] >= 0:
                out.append(pieces[at])
            else:
                out.extend([self.bytes[b] for b in reversed(unit[start:at].encode())])
            at = start
        out.reverse()
        return array("i", out).tobytes()

    def _bare(self, k: int, best: list[float], starts: list[int], pieces: list[int]) -> None:
        """Step over a character that is no piece."""
        score = best[k] + self.unknown
        if score > best[k + 1]:
            best[k + 1] = score
            starts[k + 1] = k
            pieces[k + 1] = -1

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        seen = self.seen
        units = self.units.findall(" " + text)
        parts = [seen.get(u) for u in units]
        if None in parts:
            for k, ids in enumerate(parts):
                if ids is None:
                    unit = units[k]
                    parts[k] = ids = seen.get(unit) or self.path(unit)
                    if len(unit) <= 64:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen[unit] = ids
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: Iterator[int]) -> str:
        raw = self.raw
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


_LOADED: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    """One automaton for each Python worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _run(df: DataFrame, model_path: str, id_col: str, text_col: str, decode: bool) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))  # a vocabulary file, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model.value)
        for b in batches:
            at = 0
            texts = b.column(1)
            while at < b.num_rows:
                flat, ends, chars, digests, same = [], [0], [], [], []
                start = at
                while at < b.num_rows and ends[-1] < 1 << 20:
                    text = texts[at].as_py() or ""
                    ids = pieces.encode(text)
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids))
                    chars.append(len(text))
                    if decode:
                        back = pieces.decode(ids)
                        digests.append(hashlib.sha256(back.encode()).hexdigest())
                        same.append(back == text)
                    at += 1
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                counts = pa.array(np.diff(ends), pa.int64())
                columns = {"id": b.column(0).slice(start, at - start), "n_chars": pa.array(chars, pa.int64()), "n_tokens": counts, "ids": ids}
                if decode:
                    columns |= {"decoded_sha256": pa.array(digests, pa.string()), "round_trip": pa.array(same, pa.bool_())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = df.schema[id_col].dataType.simpleString()
    more = ", decoded_sha256 string, round_trip boolean" if decode else ""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_chars long, n_tokens long, ids array<int>{more}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_chars, n_tokens and ids of every row."""
    return _run(df, model_path, id_col, text_col, decode=False)


def round_trip(df: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode``, with the SHA-256 of what the ids decode to and whether that is the text."""
    return _run(df, model_path, id_col, text_col, decode=True)


def decode(df: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns id and text of rows of ids; null ids give an empty text."""
    model = df.sparkSession.sparkContext.broadcast(_read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model.value)
        for b in batches:
            texts = [pieces.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
