"""Tables between steps, and texts as bytes.

Texts go to Python as UTF-8 bytes: ``bytes.lower`` changes A-Z only, and
``bytes.split`` and ``bytes.strip`` know exactly the white space
``[\\x20\\x09-\\x0D]``, so they agree with the rules the operators state.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import workers

WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a missing integer id inside an operator: after every other id.
LAST_ID = 2**63 - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only a local session may leave the setting out; it gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        top = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{top.rstrip('/')}/freshet-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write Parquet; the shuffle files of the job go with it, not with a later garbage collection."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """The frame, computed once and read again from the shared folder.

    A lost executor costs the running step only, and the reader knows its size.
    """
    path = shared_folder(df.sparkSession)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(a: Column, b: Column) -> Column:
    """Equality of ids in a join; null equals null."""
    return a.eqNullSafe(b)


def text_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand Python this many rows at a time at most: they are whole texts, and two workers share an executor's rest."""
    workers.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def text_bytes(name: str = "text") -> Column:
    return F.col(f"`{name}`").cast("binary")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
