"""Cutting the lineage of a plan that is read more than once, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
_rows: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def _checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder of the context: that of the session's ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; a cluster must name
    one, since a folder of one machine would not outlive an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="freshet-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder among the checkpoints, which all executors share."""
    return f"{_checkpoints(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute the frame once and keep it in the shared checkpoint folder; its rows are counted on the way."""
    _checkpoints(df.sparkSession)
    seen = Observation()
    kept = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint()
    _rows[kept] = seen.get["rows"]
    return kept


def rows_of(kept: DataFrame) -> int | None:
    """The rows of a frame from :func:`cut`, counted while it was computed; None for other frames."""
    return _rows.get(kept)


def marked(kept: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A frame from :func:`cut`, marked for broadcast up to ``limit`` rows."""
    return F.broadcast(kept) if rows_of(kept) <= limit else kept


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, computed and counted in one go; marked for broadcast up to ``limit`` rows."""
    return marked(cut(df), limit)


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group results back to the rows of the groups.

    The right side is broadcast where its counted rows allow it, so that the
    rows are not shuffled by a key that may be hot; else this is an ordinary
    join, whose hot partitions AQE splits.
    """
    return df.join(broadcast_if_small(small), list(keys), how)
