"""Line dedup against an index of line hashes: levelled sorted runs, merged batch by batch."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import LAST_ID, shared_folder, text_batches, text_bytes, unused, written

#: Keys with fewer code points are never dropped.
MIN_POINTS = 10
BATCHES = 4
FANOUT = 2


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of a line without outer white space, A-Z in lower case; None if it is too short."""
    key = line.strip().lower()
    if len(key) < 4 * MIN_POINTS and sum(b & 0xC0 != 0x80 for b in key) < MIN_POINTS:
        return None
    return xxhash.xxh3_128_digest(key)


def _document_lines(batches):
    for batch in batches:
        ids, keys = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = {line_key(line) for line in (text.as_py() or b"").split(b"\n")} - {None}
            keys.extend(found)
            ids.extend([i] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])


def document_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key)``: the distinct line keys of every row; a null id counts as the largest."""
    picked = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)), text_bytes(text_col))
    return picked.mapInArrow(_document_lines, "id long, key binary")


class LineIndex:
    """Line keys seen so far and the document that owns each.

    Runs are tables bucketed and sorted by key on levels; no key is in two
    runs. A batch is merge-joined with the runs, which are not shuffled for it,
    and what no run has becomes a run of level 0. ``fanout`` runs of one level
    are compacted to one of the next, so a key is rewritten once per level. The
    manifest in ``folder`` is written last: what it does not name does not
    count, so a broken-off step can be repeated.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = FANOUT) -> LineIndex:
        """The index that an earlier session left in ``folder``."""
        newest = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").orderBy(F.desc("version")).first()
        index = cls(spark, folder, fanout, newest["buckets"])
        index.version, index.levels = newest["version"], [list(runs) for runs in newest["levels"]]
        return index

    def _run(self, name: str) -> DataFrame:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (key BINARY, owner BIGINT) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
        )
        return self.spark.table(name)

    def _write_run(self, keys: DataFrame, level: int) -> None:
        self.version += 1
        name = f"run_{self.folder.rsplit('-', 1)[-1]}_{level}_{self.version}"
        keys.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option(
            "path", f"{self.folder}/{name}"
        ).saveAsTable(name)
        self.levels.extend([] for _ in range(level + 1 - len(self.levels)))
        self.levels[level].append(name)

    def _commit(self) -> None:
        state = self.spark.createDataFrame([(self.version, self.buckets, self.levels)], _MANIFEST)
        state.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def add(self, keys: DataFrame) -> DataFrame:
        """Add ``(key, owner, ...)`` with distinct keys; returns them with ``seen``, the owner in the runs or null."""
        found = keys
        for k, name in enumerate(name for runs in self.levels for name in runs):
            run = self._run(name).withColumnRenamed("owner", f"seen_{k}")
            found = found.join(run, "key", "left")
        seen = [c for c in found.columns if c.startswith("seen_")]
        found = written(found.select(*keys.columns, F.coalesce(F.lit(None).cast("long"), *seen).alias("seen")))
        self._write_run(found.where("seen IS NULL").select("key", "owner").repartition(self.buckets, "key"), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            runs = reduce(DataFrame.unionAll, [self._run(name) for name in old])
            self._write_run(runs.repartition(self.buckets, "key"), level + 1)
            for name in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            level += 1
        self._commit()
        return found

    def forget(self) -> None:
        """Take the runs out of the session's catalog; their files stay in the folder."""
        for name in (name for runs in self.levels for name in runs):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def owners(self) -> DataFrame:
        """``(key, owner)`` of every key."""
        return reduce(DataFrame.unionAll, [self._run(name) for runs in self.levels for name in runs])


_MANIFEST = "version long, buckets int, levels array<array<string>>"


def repeated_lines(lines: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``(id, keys)``: the line keys that a document loses, as a smaller id has the line too.

    ``lines`` has ``id`` and ``key``, written. The ids are cut into ``batches``
    ranges that go through a ``LineIndex`` in order, so the first owner of a
    key is its smallest id. Only distinct keys meet the runs, so that a line of
    many documents is one row there; documents join with the few keys that
    several of them have.
    """
    spark = lines.sparkSession
    cuts = lines.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000)).first()[0] or []
    index = LineIndex(spark, shared_folder(spark), fanout)
    shared = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = lines.where((F.col("id") > low) if low is not None else F.lit(True))
        batch = batch.where((F.col("id") <= high) if high is not None else F.lit(True))
        found = index.add(batch.groupBy("key").agg(F.min("id").alias("owner"), F.max("id").alias("last")))
        shared.append(
            found.where("seen IS NOT NULL OR owner <> last").select("key", F.coalesce("seen", "owner").alias("owner"))
        )
    index.forget()
    owners = reduce(DataFrame.unionAll, shared).distinct()
    return lines.join(owners, "key").where("id <> owner").groupBy("id").agg(F.collect_set("key").alias("keys"))


_KEPT = T.StructType(
    [T.StructField("text", T.BinaryType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
)


@F.arrow_udf(_KEPT)
def _strip(texts: pa.Array, drops: pa.Array) -> pa.Array:
    kept, total, dropped = [], [], []
    for text, drop in zip(texts, drops):
        text, drop = text.as_py(), drop.as_py()
        lines = (text or b"").split(b"\n")
        if drop:
            gone = set(drop)
            left = [line for line in lines if line_key(line) not in gone]
            text = b"\n".join(left)
        else:
            left = lines
        kept.append(text)
        total.append(len(lines))
        dropped.append(len(lines) - len(left))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
        ["text", "n_lines", "n_dropped"],
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stats: str | None = None,
    batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """The documents, without the lines that a document with a smaller id has too.

    Lines are compared without outer white space and with A-Z in lower case;
    lines of fewer than ten code points stay, and so do repeats inside the
    owning document. Other columns stay as they are. ``stats`` names a struct
    column to add, with ``n_lines`` (before) and ``n_dropped``. Null or empty
    texts are one empty line and stay as they are; rows with the same id are
    one document, and rows without an id count as the last one, so the keys
    that this one drops are one array on each of its rows. Ids must be numbers.
    An empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    lines = written(document_lines(docs, id_col, text_col))
    drop_id, drop_keys, made = (unused(docs, name) for name in ("drop_id", "drop_keys", "made"))
    drops = repeated_lines(lines, batches, fanout).toDF(drop_id, drop_keys)
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID))
    joined = docs.join(drops, own == F.col(drop_id), "left")
    stripped = joined.withColumn(made, _strip(text_bytes(text_col), F.col(drop_keys)))
    columns = [
        F.col(f"{made}.text").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns
    ]
    if stats:
        columns.append(F.struct(f"{made}.n_lines", f"{made}.n_dropped").alias(stats))
    return stripped.select(*columns)
