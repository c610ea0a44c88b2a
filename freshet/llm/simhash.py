"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import text_batches, text_bytes, unused, written
from freshet.llm.components import connected

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer; the midpoints below are made for two.
DISTANCE = 2
BLOCKS = 5
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The SimHash of the lower-cased word shingles of a text, unsigned; no words give 0.

    A text with fewer words than a shingle has is one shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for k in range(0, n, _CHUNK):
        part = hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row: the fingerprint of its whole text as a signed long."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), _fingerprint(text_bytes(text_col)).alias("fp"))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of the bits that two fingerprints may have to share.

    The 64 bits are cut into ``blocks`` blocks. Fingerprints that differ in at
    most ``distance`` bits agree on all but ``distance`` blocks, so they are
    equal under at least one mask.
    """
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(kept) for kept in combinations(block, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``(fp, hub)`` pairs that connect all fingerprints at two differing bits or fewer.

    ``fps`` has distinct ``fp``. Rows that share a block key stay candidates.
    Two of them at distance two or less have a common midpoint, a value that
    differs from each in one free bit or none; so each candidate goes to its
    own midpoints, and at a midpoint (which at most one more than the free
    bits can reach) all link to the smallest. The number of rows is linear in the candidates, whatever
    the size of a group; no link is lost.
    """
    masks = block_masks(blocks)
    keys = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, m in enumerate(masks)])).alias("key")
    ).select("fp", "key.mask", "key.part")
    shared = keys.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    free = F.array(*[F.array(*[F.lit(0)], *[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in masks])
    return (
        keys.join(shared, ["mask", "part"])
        .select("fp", "mask", F.explode(F.get(free, F.col("mask"))).alias("flip"))
        .groupBy("mask", F.col("fp").bitwiseXOR(F.col("flip")).alias("midpoint"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.explode("fps").alias("fp"), F.array_min("fps").alias("hub"))
        .where((F.col("fp") != F.col("hub")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= DISTANCE))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` of every row; the component is the smallest id that links reach.

    Null and empty texts have fingerprint zero and link like any other; a null
    id is returned with its component and never names one, unless all ids of a
    component are null. Repeated rows are returned as often as they are given.
    Equal fingerprints meet before the search, so copies cost one row.
    """
    text_batches(docs.sparkSession)
    rows = written(fingerprints(docs, id_col, text_col))
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")))
    root = connected(links(distinct.select("fp"))).toDF("fp", "root")
    label = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = label.groupBy("root").agg(F.min("least").alias("component"))
    label = label.join(least, "root").select("fp", "component")
    return rows.join(label, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest id stays.

    Columns stay as they are. Rows with the same id are one document, of which
    one row stays. Rows without an id cannot be told apart and all stay.
    """
    return keep_least(docs, near_duplicates(docs, id_col, text_col), id_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that name a component of ``found``, which has ``id`` and ``component`` of every row of ``docs``."""
    kept_id = unused(docs, "kept_id")
    kept = found.where(F.col("id") == F.col("component")).select(F.col("id").alias(kept_id)).distinct()
    named = docs.join(kept, F.col(f"`{id_col}`") == F.col(kept_id), "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
