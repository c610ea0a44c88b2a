"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a Viterbi search.

The automaton reads a text once. At each position it follows the output links
through all pieces that end there, the longest first, and each of them relaxes
the best score of a segmentation up to that position.

A text is encoded as the library does it for a unigram model with these scores
and an identity normaliser: one space is put in front, spaces become U+2581,
and a character that no piece has becomes the pieces of its bytes. One thing
differs, so that decoding is exact: a U+2581 of the text itself becomes bytes.
Files of the kind "BPE" hold merge ranks and no log probabilities; ``ranked``
turns rank r into the log probability that Zipf's law gives it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import text_batches, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: An unknown character costs this much more than the rarest piece.
UNKNOWN_COST = 10.0
#: Segmented words that a worker remembers; what it forgets is segmented anew.
REMEMBERED = 50_000
_LONGEST_REMEMBERED = 48


@dataclass(frozen=True)
class Pieces:
    """A piece table: texts by id (None for control pieces), log probabilities, ids of the 256 byte pieces."""

    texts: tuple[str | None, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]


def ranked(n: int) -> list[float]:
    """Log probabilities of n pieces by rank under Zipf's law."""
    harmonic = float(np.sum(1.0 / np.arange(1, n + 1)))
    return [-log(r + 1) - log(harmonic) for r in range(n)]


def load(path: str = MODEL, scores: str = "rank") -> Pieces:
    """The table of a model file; ``scores`` is "rank" (place in the file) or "file" (as stored there)."""
    from sentencepiece import SentencePieceProcessor

    if scores not in ("rank", "file"):
        raise ValueError(f"scores must be 'rank' or 'file', not {scores!r}")
    model = SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    byte_ids = [i for i in ids if model.is_byte(i)]
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces")
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    values = ranked(len(plain)) if scores == "rank" else [model.get_score(i) for i in plain]
    texts: list[str | None] = [None] * len(ids)
    table = [0.0] * len(ids)
    for i, score in zip(plain, values):
        texts[i], table[i] = model.id_to_piece(i), score
    return Pieces(tuple(texts), tuple(table), tuple(byte_ids))


class _Remembered(dict):
    """Words and their ids as packed int32; older words leave when ``REMEMBERED`` newer ones have come."""

    def __init__(self, segment):
        self.segment = segment
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.segment(word), np.int32).tobytes()
        if len(word) <= _LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _words(texts: list[str]) -> re.Pattern:
    """Cuts a text only where no piece goes on, so that the cuts do not change its segmentation.

    That is before spaces, behind letters where the next character follows a
    letter in no piece, and around control characters that are in no longer piece.
    """
    if any(SPACE in t.lstrip(SPACE) for t in texts):
        return re.compile("(?s:.+)")
    behind = {b for t in texts for a, b in zip(t, t[1:]) if a.isalpha()}
    goes_on = "".join(map(re.escape, sorted(b for b in behind if not b.isalpha())))
    inside = {c for t in texts if len(t) > 1 for c in t}
    alone = "".join(re.escape(c) for c in map(chr, range(32)) if c not in inside)
    return re.compile(rf"{SPACE}*+[^\W\d_]++(?![{goes_on}\d])|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]+")


@dataclass
class Codec:
    """Encodes and decodes texts given as UTF-8; bytes that are not UTF-8 become byte pieces."""

    pieces: Pieces
    _words: _Remembered = field(init=False, repr=False)

    def __post_init__(self):
        automaton = ahocorasick.Automaton()
        for i, (text, score) in enumerate(zip(self.pieces.texts, self.pieces.scores)):
            if text is not None:
                automaton.add_word(text, (i, len(text), score))
        automaton.make_automaton()
        texts = [t for t in self.pieces.texts if t is not None]
        self._automaton = automaton
        self._single = {t for t in texts if len(t) == 1}
        self._unknown = min(s for t, s in zip(self.pieces.texts, self.pieces.scores) if t is not None) - UNKNOWN_COST
        self._word = _words(texts)
        self._words = _Remembered(self.segment)
        self._space = b"".join(np.int32(self.pieces.byte_ids[b]).tobytes() for b in SPACE.encode())
        raw = [(t or "").replace(SPACE, " ").encode() for t in self.pieces.texts]
        for b, i in enumerate(self.pieces.byte_ids):
            raw[i] = bytes([b])
        self._raw = raw

    def segment(self, text: str) -> list[int]:
        """The ids of the best segmentation; of equal ones that whose last piece is longer."""
        n = len(text)
        best, back = [float("-inf")] * (n + 1), [(-1, 1)] * (n + 1)
        best[0] = 0.0
        single = self._single
        gaps = [] if single.issuperset(text) else [k for k, c in enumerate(text) if c not in single]
        gap = 0
        for end, piece in self._automaton.iter(text):
            while gap < len(gaps) and gaps[gap] < end:
                self._bytes_at(gaps[gap], best, back)
                gap += 1
            total = best[end + 1 - piece[1]] + piece[2]
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, piece
        for k in gaps[gap:]:
            self._bytes_at(k, best, back)
        ids: list[int] = []
        while n:
            piece = back[n]
            n -= piece[1]
            if piece[0] >= 0:
                ids.append(piece[0])
            else:
                ids.extend(self.pieces.byte_ids[b] for b in reversed(text[n].encode("utf-8", "surrogateescape")))
        ids.reverse()
        return ids

    def _bytes_at(self, k: int, best: list[float], back: list[tuple]) -> None:
        """Relax the step over character k, which is no piece itself."""
        total = best[k] + self._unknown
        if total > best[k + 1]:
            best[k + 1], back[k + 1] = total, (-1, 1)

    def encode(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = (" " + text.decode("utf-8", "surrogateescape")).split(SPACE)
        words = self._words.__getitem__
        coded = [b"".join(map(words, self._word.findall(p.replace(" ", SPACE)))) for p in parts]
        return np.frombuffer(self._space.join(coded), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self._raw.__getitem__, ids.tolist()))[1:]


_codecs: dict[int, Codec] = {}


def _codec(pieces) -> Codec:
    """The codec of a broadcast table, built once per Python worker."""
    if pieces.value is not None and id(pieces.value) not in _codecs:
        _codecs.clear()
        _codecs[id(pieces.value)] = Codec(pieces.value)
    return _codecs[id(pieces.value)]


def _ids_array(found: list[np.ndarray | None]) -> pa.Array:
    lengths = np.array([0 if ids is None else len(ids) for ids in found], np.int64)
    missing = np.array([ids is None for ids in found] + [False])
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32(), mask=missing)
    values = np.concatenate([np.zeros(0, np.int32), *(ids for ids in found if ids is not None)])
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))


_IDS = T.ArrayType(T.IntegerType())


def codec_columns(docs: DataFrame, pieces: Pieces):
    """Column functions: texts to ``struct<ids, back>``, their ids and what those decode to; ids to texts.

    Null stays null; an empty text has no ids. The piece table, bounded by the
    vocabulary, is broadcast. Both directions of the first share one Python
    worker, as each worker has a table of its own.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf(T.StructType([T.StructField("ids", _IDS), T.StructField("back", T.BinaryType())]))
    def encode(texts: pa.Array) -> pa.Array:
        codec = _codec(shared)
        found = [None if t is None else codec.encode(t) for t in (text.as_py() for text in texts)]
        back = pa.array([None if ids is None else codec.decode(ids) for ids in found], pa.binary())
        return pa.StructArray.from_arrays([_ids_array(found), back], ["ids", "back"])

    @F.arrow_udf(T.BinaryType())
    def decode(ids: pa.Array) -> pa.Array:
        codec = _codec(shared)
        return pa.array([codec.decode(row.values.to_numpy()) if row.is_valid else None for row in ids], pa.binary())

    once = encode.asNondeterministic()  # else Spark encodes again for every use of the ids

    def encoded(text_col: str = "text") -> Column:
        return once(text_bytes(text_col))

    def decoded(ids_col: str) -> Column:
        return decode(F.col(f"`{ids_col}`")).cast("string")

    return encoded, decoded
