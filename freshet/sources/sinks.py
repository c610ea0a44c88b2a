"""Writers of tidy tables and report sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_tidy(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """A tidy table as files, partitioned by the columns readers filter on."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_reports(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """A report set tagged by ``grouping``, one directory per grouping."""
    write_tidy(df, path, fmt, ["grouping"], mode)
