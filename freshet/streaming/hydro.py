"""The first steps of the storm pipeline over a stream of readings.

Storm numbers need the whole record, so streamed storms are known by
``(site, start_date)``. Windows close once the watermark passes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.clock import hours_between, plus_minutes
from freshet.operators.storms import is_wet, with_flow_columns


def resample_stream(
    readings: DataFrame,
    period_minutes: int = 10,
    late: str = "1 hour",
    ts: str = "ts",
    means: tuple[str, ...] = ("head_mm",),
    sums: tuple[str, ...] = ("precip_mm",),
) -> DataFrame:
    """Regular bins of a stream; readings later than ``late`` are left out."""
    return (
        readings.withWatermark(ts, late)
        .groupBy("site", F.window(ts, f"{period_minutes} minutes").alias("_w"))
        .agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])
        .select("site", F.col("_w.start").alias(ts), *means, *sums)
    )


def storm_sessions(
    bins: DataFrame, interevent_hours: float = 6, period_minutes: int = 10, late: str = "1 hour"
) -> DataFrame:
    """Storms of a stream of regular bins, one row each when it closes.

    ``bins`` carries bin starts; a session ends when the next wet bin starts
    more than ``interevent_hours`` later, which on the grid is the batch rule.
    """
    seconds = int(round(interevent_hours * 3600))
    return (
        with_flow_columns(bins)
        .filter(is_wet())
        .withWatermark("ts", late)
        .groupBy("site", F.session_window("ts", f"{seconds} seconds").alias("_s"))
        .agg(
            F.min("ts").alias("start_date"),
            F.max("ts").alias("_last"),
            F.sum("precip_mm").alias("total_precip_depth"),
            (F.max("precip_mm") * F.lit(60.0 / period_minutes)).alias("peak_precip_intensity"),
        )
        .withColumn("end_date", plus_minutes("_last", period_minutes))
        .select(
            "site", "start_date", "end_date",
            hours_between("start_date", "end_date").alias("duration_hours"),
            "total_precip_depth", "peak_precip_intensity",
        )
    )
