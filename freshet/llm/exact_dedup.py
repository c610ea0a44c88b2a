"""Exact dedup with an extendible-hash index on shared files.

The directory maps hash prefixes to buckets. A bucket that would hold more than
its capacity is split by one more bit of the hash, which doubles the part of
the directory under it, until its parts fit. Owner tasks take whole buckets:
they read them in hash order, chain the texts of one hash and compare their
bytes, so that a collision of hashes never merges two texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import shared_folder, text_batches, text_bytes, write_table, written
from freshet.operators.spread import numbered

#: Text bytes that a bucket holds before it is split.
CAPACITY = 32 << 20
#: Bits of the hash that the directory can use, so it has 65,536 lines at most.
MAX_DEPTH = 16
#: Stands for a missing id: before every other id.
FIRST_ID = -(2**63)
_FLUSH = 16 << 20
_ENTRY = "hash long, sha256 binary, text binary, chain int, keep_id long, n long"
_DIRECTORY = "version long, prefix string, bytes long, files long"


def _hash(text: bytes) -> int:
    """The XXH64 of a text, moved into the signed range in order."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(text.as_py() or b"").lower() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(map(_hash, texts), pa.int64()),
                pa.array([hashlib.sha256(text).digest() for text in texts], pa.binary()),
                pa.array(map(len, texts), pa.int64()),
            ],
            ["id", "hash", "sha256", "bytes"],
        )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, hash, sha256, bytes)`` of every text with A-Z in lower case; null texts are empty, null ids come first."""
    return _picked(docs, id_col, text_col).mapInArrow(_signatures, "id long, hash long, sha256 binary, bytes long")


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(FIRST_ID)), text_bytes(text_col))


def _batch(rows: list[tuple], prefixes: list[str], bounds: list[int]) -> pa.RecordBatch:
    """Entries (hash, text, chain, keep_id, n) with their digests and buckets."""
    h, text, chain, keep, n = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [
            pa.array(h, pa.int64()),
            pa.array([hashlib.sha256(t).digest() for t in text], pa.binary()),
            pa.array(text, pa.binary()),
            pa.array(chain, pa.int32()),
            pa.array(keep, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array([prefixes[bisect_right(bounds, x) - 1] for x in h], pa.string()),
        ],
        ["hash", "sha256", "text", "chain", "keep_id", "n", "bucket"],
    )


def _arrivals(prefixes: list[str], bounds: list[int]):
    """Documents as entries, one per distinct text of an Arrow batch, so that few copies travel."""

    def arrivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                entry = found.setdefault((text.as_py() or b"").lower(), [i, 0])
                entry[0], entry[1] = max(entry[0], i), entry[1] + 1
            yield _batch([(_hash(text), text, 0, *entry) for text, entry in found.items()], prefixes, bounds)

    return arrivals


def _owned(prefixes: list[str], bounds: list[int]):
    """What an owner task makes of its buckets, in hash order: the texts of a hash in a chain, equal bytes as one entry."""

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_now, chain = None, {}
        rows, held = [], 0
        for batch in batches:
            for h, text, keep, n in zip(*(batch.column(c) for c in ("hash", "text", "keep_id", "n"))):
                h, text, keep = h.as_py(), text.as_py(), keep.as_py()
                if h != hash_now:
                    rows += [(hash_now, t, k, *entry) for k, (t, entry) in enumerate(chain.items())]
                    held += sum(map(len, chain))
                    hash_now, chain = h, {}
                    if held > _FLUSH:
                        yield _batch(rows, prefixes, bounds)
                        rows, held = [], 0
                entry = chain.setdefault(text, [keep, 0])
                entry[0], entry[1] = max(entry[0], keep), entry[1] + n.as_py()
        rows += [(hash_now, t, k, *entry) for k, (t, entry) in enumerate(chain.items())]
        yield _batch(rows, prefixes, bounds)

    return owned


def directory_for(sizes: dict[int, int], capacity: int) -> dict[str, int]:
    """Bucket prefixes and the bytes under each, from the bytes under each of the 2^MAX_DEPTH longest prefixes."""
    order = sorted(sizes)

    def bucket(prefix: str, low: int, high: int) -> dict[str, int]:
        total = sum(sizes[p] for p in order[low:high])
        if total <= capacity or len(prefix) == MAX_DEPTH:
            return {prefix: total}
        middle = bisect_right(order, int((prefix + "1").ljust(MAX_DEPTH, "0"), 2) - 1)
        return bucket(prefix + "0", low, middle) | bucket(prefix + "1", middle, high)

    return bucket("", 0, len(order))


class ExactIndex:
    """Distinct texts, how often each was inserted and its largest id, in the buckets of a directory.

    Files are never changed: an insert writes the buckets that it touches anew,
    and last the directory that names them, so a broken-off insert leaves the
    index as it was and can be repeated.
    """

    def __init__(self, spark: SparkSession, folder: str, capacity: int = CAPACITY):
        self.spark, self.folder, self.capacity = spark, folder, capacity
        self.version = 0
        #: Bucket prefix: its bytes, and the version that wrote its files.
        self.directory: dict[str, tuple[int, int]] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str, capacity: int = CAPACITY) -> ExactIndex:
        """The index that an earlier session left in ``folder``."""
        index = cls(spark, folder, capacity)
        lines = spark.read.schema(_DIRECTORY).json(f"{folder}/directory")
        index.version = lines.agg(F.max("version")).first()[0]
        newest = lines.where(F.col("version") == index.version).collect()
        index.directory = {r["prefix"]: (r["bytes"], r["files"]) for r in newest}
        return index

    def entries(self) -> DataFrame:
        """``(hash, sha256, text, chain, keep_id, n)`` of every distinct text, with its bucket."""
        parts = []
        for version in sorted({files for _, files in self.directory.values()}):
            buckets = [f"b{p}" for p, (_, files) in self.directory.items() if files == version]
            stored = self.spark.read.schema(f"{_ENTRY}, bucket string").parquet(f"{self.folder}/v{version}")
            parts.append(stored.where(F.col("bucket").isin(buckets)))
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], f"{_ENTRY}, bucket string")

    def insert(self, docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents; ``marks`` are their ``signatures``, written."""
        leading = F.shiftright("hash", 64 - MAX_DEPTH) + (1 << MAX_DEPTH - 1)
        new = marks.select("hash", "sha256", "bytes").distinct().groupBy(leading.alias("slot")).agg(F.sum("bytes").alias("bytes"))
        arriving = {r["slot"]: r["bytes"] for r in new.collect()}
        sizes = dict(arriving)
        if self.directory:
            old = self.entries().groupBy(leading.alias("slot")).agg(F.sum(F.octet_length("text")).alias("bytes"))
            for r in old.collect():
                sizes[r["slot"]] = sizes.get(r["slot"], 0) + r["bytes"]
        grown = directory_for(sizes, self.capacity)
        prefixes = sorted(grown, key=lambda p: p.ljust(MAX_DEPTH, "0"))
        bounds = [(int(p.ljust(MAX_DEPTH, "0"), 2) << 64 - MAX_DEPTH) - (1 << 63) for p in prefixes]
        names = [f"b{p}" for p in prefixes]
        slots = [int(p.ljust(MAX_DEPTH, "0"), 2) for p in prefixes]
        touched = {prefixes[bisect_right(slots, s) - 1] for s in arriving} | {p for p in prefixes if p not in self.directory}

        entry = f"{_ENTRY}, bucket string"
        arrivals = _picked(docs, id_col, text_col).mapInArrow(_arrivals(names, bounds), entry)
        if self.directory:
            kept = {p for p in self.directory if p in grown and p not in touched}
            moved = self.entries().where(~F.col("bucket").isin([f"b{p}" for p in kept]))
            arrivals = arrivals.unionAll(moved.mapInArrow(_owned(names, bounds), entry))
        owners = arrivals.repartition(len(prefixes), "bucket").sortWithinPartitions("bucket", "hash")
        self.version += 1
        write_table(owners.mapInArrow(_owned(names, bounds), entry), f"{self.folder}/v{self.version}", ["bucket"])
        self.directory = {
            p: (size, self.version if p in touched else self.directory[p][1]) for p, size in grown.items()
        }
        lines = [(self.version, p, *line) for p, line in self.directory.items()]
        self.spark.createDataFrame(lines, _DIRECTORY).coalesce(1).write.mode("append").json(f"{self.folder}/directory")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """``(id, keep_id, n, kept, sha256)`` of every row: its class of equal texts and whether it stays.

    Texts are equal when their bytes are, A-Z in lower case; a null text is
    empty. The row with the largest id stays. A missing id is smaller than all
    others and comes back as null; of rows with the same id and text one stays.
    Ids must be numbers. An empty table gives an empty table, and texts of any
    length are compared whole.
    """
    text_batches(docs.sparkSession)
    marks = written(signatures(docs, id_col, text_col))
    index = ExactIndex(docs.sparkSession, shared_folder(docs.sparkSession), capacity)
    index.insert(docs, marks, id_col, text_col)
    classes = index.entries().select("hash", "sha256", "keep_id", "n")
    members = marks.join(classes, ["hash", "sha256"]).select("id", "keep_id", "n", "sha256")
    staying = members.where("id = keep_id").groupBy("id", "keep_id", "n", "sha256").agg(F.count("*").alias("rows"))
    # rows without an id may be many: they are numbered in blocks, by several tasks
    staying = numbered(staying, ["id", "sha256"], "rows", "row")
    judged = members.where("id <> keep_id").withColumn("kept", F.lit(False)).unionByName(
        staying.select("id", "keep_id", "n", "sha256", (F.col("row") == 1).alias("kept"))
    )
    named = [F.when(F.col(c) != FIRST_ID, F.col(c)).alias(c) for c in ("id", "keep_id")]
    return judged.select(*named, "n", "kept", "sha256")
