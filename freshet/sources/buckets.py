"""Stored records whose scans need no shuffle: buckets by site and month, sorted by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.functions.clock import month_index

MONTH = "month"
#: A bucket holds whole site-months; make it a multiple of the cores that read the table.
BUCKETS = 64


def write_record(record: DataFrame, table: str, path: str | None = None, buckets: int = BUCKETS, mode: str = "errorifexists") -> None:
    """Store readings or bins (``site``, ``ts``, values) as a table of the session's catalog.

    The column ``month`` is added. Rows of a site-month are in one bucket, in
    the order of time, so what works by site and month (storm labels, bins of
    readings) reads its rows where they are. A site is spread over as many
    buckets as it has months. ``path`` names the folder of the files; else they
    are in the warehouse.
    """
    writer = record.withColumn(MONTH, month_index("ts")).repartition(buckets, "site", MONTH).write.mode(mode)
    writer = writer.bucketBy(buckets, "site", MONTH).sortBy("site", MONTH, "ts").format("parquet")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def read_record(spark: SparkSession, table: str) -> DataFrame:
    """A table of :func:`write_record`, its ``month`` included: the operators use it where they find it."""
    return spark.table(table)
