"""Sensor records: regular bins, gauge join and rating curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.operators.intervals import join_on_grid


def head_above_weir(readings: DataFrame, sites: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Add ``head_mm``: level less the weir height of the reading's site."""
    weirs = sites.select(*keys, "weir_height_mm")
    return (
        readings.join(weirs, list(keys), "inner")
        .withColumn("head_mm", F.col("level_mm") - F.col("weir_height_mm"))
        .drop("weir_height_mm")
    )


def _bin_start(period_minutes: int | None, ts: str) -> Column:
    """The start of a reading's bin; bins are counted from 1970-01-01 whatever their length."""
    return F.col(ts) if period_minutes is None else F.window(F.col(ts), f"{period_minutes} minutes")["start"]


def resample(
    readings: DataFrame,
    period_minutes: int | None = 10,
    ts: str = "ts",
    means: tuple[str, ...] = ("head_mm",),
    sums: tuple[str, ...] = ("precip_mm",),
    by: tuple[str, ...] = ("site",),
) -> DataFrame:
    """Means and sums per regular bin; ``period_minutes=None`` keeps readings.

    Bins start at the returned ``ts``. Only bins with readings are returned;
    :func:`fill_bins` adds the empty ones.
    """
    if period_minutes is None:
        return readings.select(*by, ts, *means, *sums)
    return readings.groupBy(*by, _bin_start(period_minutes, ts).alias(ts)).agg(
        *[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums]
    )


def fill_bins(
    binned: DataFrame, period_minutes: int = 10, ts: str = "ts", by: tuple[str, ...] = ("site",), chunk: int = 1000
) -> DataFrame:
    """Add empty bins (null values) between each site's first and last bin.

    The bins are numbered from 1970-01-01 as :func:`resample` does, so every
    given bin is met at any period, also one that does not divide a day.
    """
    minute = F.timestamp_diff("MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    number = F.floor(minute / period_minutes)
    spans = binned.groupBy(*by).agg(F.min(number).alias("_from"), F.max(number).alias("_to"))
    # chunks of bins first, then the bins of a chunk: no array holds a whole record
    chunks = spans.withColumn(
        "_chunk", F.explode(F.sequence(F.floor(F.col("_from") / chunk), F.floor(F.col("_to") / chunk)))
    )
    first = F.greatest("_from", F.col("_chunk") * chunk)
    last = F.least("_to", F.col("_chunk") * chunk + (chunk - 1))
    start = F.expr(f"TIMESTAMP_NTZ'1970-01-01' + make_dt_interval(0, 0, CAST(_bin * {period_minutes} AS INT))")
    spine = chunks.withColumn("_bin", F.explode(F.sequence(first, last))).select(*by, start.alias(ts))
    return spine.join(binned, [*by, ts], "left")


def gauged_record(
    readings: DataFrame, sites: DataFrame, period_minutes: int | None = 10, ts: str = "ts"
) -> DataFrame:
    """Regular bins of each site's own head and of the rain at its gauge.

    The same rows as binning heads and rain apart and joining them (see
    :func:`join_gauge`), from one scan: readings are binned by the site that
    took them, and the bins, not the readings, go to that site as heads and to
    the sites of its gauge as rain. ``period_minutes=None`` merges readings of
    the same time only. Readings that are stored by site and month
    (:mod:`freshet.sources.buckets`) are binned without a shuffle, as long as a
    bin lies in one month.
    """
    month = ["month"] if "month" in readings.columns and period_minutes is not None and 1440 % period_minutes == 0 else []
    bins = readings.groupBy(F.col("site").alias("_source"), *month, _bin_start(period_minutes, ts).alias(ts)).agg(
        F.avg("level_mm").alias("_level"), F.sum("precip_mm").alias("_precip")
    )
    heads = sites.select(F.col("site").alias("_source"), "site", "weir_height_mm", F.lit(False).alias("_rain"))
    rains = sites.select(
        F.col("raingauge").alias("_source"), "site", F.lit(None).cast("int").alias("weir_height_mm"), F.lit(True).alias("_rain")
    )
    routed = bins.join(heads.unionByName(rains), "_source", "inner")
    return routed.groupBy("site", ts).agg(
        F.max(F.col("_level") - F.col("weir_height_mm")).alias("head_mm"),
        F.max(F.when(F.col("_rain"), F.col("_precip"))).alias("precip_mm"),
    )


def join_gauge(
    heads: DataFrame, rain: DataFrame, gauges: DataFrame, ts: str = "ts"
) -> DataFrame:
    """Full outer join of each site's head with the rain of its gauge.

    ``gauges`` maps ``site`` to ``raingauge``, itself a site of ``rain``.
    """
    at_gauge = rain.select(F.col("site").alias("raingauge"), ts, "precip_mm")
    site_rain = at_gauge.join(gauges.select("site", "raingauge"), "raingauge", "inner").drop("raingauge")
    return site_rain.join(heads.select("site", ts, "head_mm"), ["site", ts], "full").select(
        "site", ts, "precip_mm", "head_mm"
    )


def curve_segments(curve: DataFrame, key: str = "site") -> DataFrame:
    """Consecutive points of each rating curve; the last has no upper end."""
    w = Window.partitionBy(key).orderBy("head_mm", "flow_lps")
    return curve.select(
        key,
        F.col("head_mm").alias("_h0"),
        F.col("flow_lps").alias("_f0"),
        F.lead("head_mm").over(w).alias("_h1"),
        F.lead("flow_lps").over(w).alias("_f1"),
    )


def rate_flow(
    record: DataFrame, curve: DataFrame, key: str = "site", head: str = "head_mm", grid_mm: float = 25.0
) -> DataFrame:
    """Add ``flow_lps`` by linear interpolation; null outside the curve."""

    def cell(h: Column) -> Column:
        return F.floor(h / F.lit(grid_mm))

    h = F.col(head)
    upper = F.coalesce(F.col("_h1"), F.col("_h0"))
    within = (h >= F.col("_h0")) & ((h < F.col("_h1")) | (F.col("_h1").isNull() & (h == F.col("_h0"))))
    slope = (F.col("_f1") - F.col("_f0")) / F.nullif(F.col("_h1") - F.col("_h0"), F.lit(0.0))
    return (
        join_on_grid(
            record, curve_segments(curve, key), [key], cell(h), cell(F.col("_h0")), cell(upper), within
        )
        .withColumn("flow_lps", F.col("_f0") + F.coalesce(slope * (h - F.col("_h0")), F.lit(0.0)))
        .drop("_h0", "_f0", "_h1", "_f1")
    )


def record_maxima(record: DataFrame, columns: tuple[str, ...] = ("precip_mm", "flow_lps", "inflow_lps")) -> DataFrame:
    """Largest value of each quantity in each site's record."""
    return record.groupBy("site").agg(*[F.max(c).alias(f"max_{c}") for c in columns])

