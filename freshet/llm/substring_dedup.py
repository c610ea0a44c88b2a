"""Substring dedup: winnowed anchors seed repeats, which are extended both ways and kept from a length on.

Every window of ``WINDOW`` words has one anchor, the smallest hash of its
``GRAM``-word grams, so equal windows have equal anchors. Anchors that several
documents share are the seeds. A seed is extended to all windows around it that
have it as their anchor; a window that an earlier document has too extends the
repeat, and runs of such windows are the maximal repeats. Extension compares
window hashes (96 bits) instead of pairs of documents, so the work is linear in
the words around seeds, however many documents share a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import LAST_ID, shared_folder, text_batches, text_bytes, write_table, written

WINDOW = 13
GRAM = 6
#: Windows are compared in so many rounds by their hash, so that one round's shuffle is on disk at a time.
ROUNDS = 4
_A, _B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * _MIX
    return h ^ h >> np.uint64(32)


def word_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, size: int, factor: np.uint64 = _A) -> np.ndarray:
    """A hash of every ``size`` consecutive words; none if there are fewer."""
    n = len(words) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        total = total * factor + words[k : k + n]
    return _mixed(total)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def window_anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of every window of a text, in order."""
    grams = gram_hashes(words, GRAM)
    return _least(grams, WINDOW - GRAM + 1) if len(words) >= WINDOW else grams[:0]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(window_anchors(word_hashes(text.as_py()))) for text in batch.column(2)]
        ids, rows = (np.repeat(batch.column(k).to_numpy(), [len(f) for f in found]) for k in range(2))
        anchors = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], ["anchor", "id", "row"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
        for i, row, text, seeds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            words = word_hashes(text.as_py())
            at = np.isin(window_anchors(words), seeds.values.to_numpy().view(np.uint64)).nonzero()[0]
            one, two = gram_hashes(words, WINDOW)[at], gram_hashes(_mixed(words), WINDOW, _B)[at]
            parts.append((one, two, np.full(len(at), i, np.int64), np.full(len(at), row, np.int64), at))
        one, two, ids, rows, at = map(np.concatenate, zip(*parts))
        columns = [one.view(np.int64), (two >> np.uint64(32)).astype(np.uint32).view(np.int32), ids, rows, at.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "id", "row", "at"])


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, row, text)``: the id tells which document is earlier; together with the hash of the text it names the row."""
    text = text_bytes(text_col)
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, row, starts)``: where the windows of a text start that a document with a smaller id has too.

    Starts count words from 0. Texts without such a window have no row; a null
    id counts as the largest. Rows with the same id do not cut each other, and
    each text among them (``row``) has starts of its own.
    """
    picked = _identified(docs, id_col, text_col)
    anchors = picked.mapInArrow(_anchors, "anchor long, id long, row long")
    several = anchors.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    seeds = written(several.select("anchor"))
    seeded = written(anchors.join(seeds, "anchor").groupBy("id", "row").agg(F.collect_set("anchor").alias("seeds")))
    windows = picked.join(seeded, ["id", "row"]).select("id", "row", "text", "seeds").mapInArrow(_windows, "one long, two int, id long, row long, at int")
    path = shared_folder(docs.sparkSession)
    write_table(windows.withColumn("round", F.pmod("one", F.lit(ROUNDS)).cast("int")), path, ["round"])
    stored = docs.sparkSession.read.schema("one long, two int, id long, row long, at int, round int").parquet(path)
    found = []
    for k in range(ROUNDS):
        part = stored.where(F.col("round") == k)
        owned = part.groupBy("one", "two").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
        # Written, so that the join has two plain shuffles, of which Spark can split a window that many documents have.
        owners = written(owned.where("owner <> last").drop("last"))
        later = part.join(owners, ["one", "two"]).where("id <> owner")
        found.append(written(later.groupBy("id", "row").agg(F.collect_set("at").alias("starts"))))
    return reduce(DataFrame.unionAll, found).groupBy("id", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"))


_CUT = T.StructType(
    [
        T.StructField("text", T.BinaryType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    ]
)


def cut_windows(text: bytes | None, starts: list[int] | None) -> tuple[bytes, int, int, list[dict]]:
    """The words that no window covers, joined by a space; how many there were and went; the maximal runs that went."""
    words = (text or b"").split()
    if not starts:
        return b" ".join(words), len(words), 0, []
    steps = np.zeros(len(words) + 1, np.int64)
    begins = np.array([s for s in starts if s + WINDOW <= len(words)], np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + WINDOW, -1)
    gone = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])]
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g]), len(words), int(gone.sum()), spans


@F.arrow_udf(_CUT)
def _cut(texts: pa.Array, starts: pa.Array) -> pa.Array:
    found = [cut_windows(text.as_py(), s.as_py()) for text, s in zip(texts, starts)]
    columns = list(zip(*found)) or [[]] * 4
    types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.name for f in _CUT])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_words, n_removed, spans)`` of every row: its words without the repeats of earlier documents.

    Windows are judged on the input, not on what is left. Words are kept as
    they are, one space between them; ``spans`` are the maximal repeats that
    went, as word positions. Null texts have no words. Texts shorter than a
    window stay whole. An empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    starts = repeated_windows(docs, id_col, text_col)
    picked = _identified(docs, id_col, text_col)
    made = picked.join(starts, ["id", "row"], "left").select("id", _cut("text", "starts").alias("cut"))
    return made.select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("id"), F.col("cut.text").cast("string").alias("text"),
        "cut.n_words", "cut.n_removed", "cut.spans",
    )
