"""Storms: detection, per-storm statistics, edits and exclusions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.functions import volumes
from freshet.functions.clock import (
    day_index,
    days_between,
    epoch_seconds,
    hours_between,
    micros_between,
    month_index,
    plus_minutes,
    with_time_groups,
)
from freshet.operators.intervals import join_on_grid
from freshet.operators.lineage import cut, join_small
from freshet.operators.spread import GROUP_ROWS, ranked_values, value_at

# --- fixed values: column order of the storm table ---
STORM_COLUMNS = (
    "site", "storm_number", "year", "season", "grouped_season", "antecedent_days",
    "start_date", "end_date", "duration_hours", "peak_precip_intensity",
    "total_precip_depth", "runoff_m3", "bypass_m3", "inflow_m3", "outflow_m3",
    "outflow_mm", "peak_outflow", "centroid_lag_hours", "peak_lag_hours",
    "has_outflow", "sm_est_peak_inflow",
)

_RAIN, _IN, _OUT = "precip_mm", "inflow_lps", "flow_lps"


def with_flow_columns(record: DataFrame) -> DataFrame:
    """Add the flow columns a record lacks, as nulls."""
    missing = {c: F.lit(None).cast("double") for c in (_RAIN, _IN, _OUT) if c not in record.columns}
    return record.withColumns(missing) if missing else record


def is_wet() -> Column:
    """Rain, inflow or outflow above zero."""
    return (F.col(_RAIN) > 0) | (F.col(_IN) > 0) | (F.col(_OUT) > 0)


def _edit_marks(edits: DataFrame) -> DataFrame:
    """Storm edits as rows of the record, each changing a running total."""
    kinds = F.array(
        F.struct(F.col("mute_from").alias("ts"), F.lit(0).alias("_order"), F.lit(1).alias("_mute"), F.lit(0).alias("_shift")),
        F.struct(F.col("mute_to").alias("ts"), F.lit(2).alias("_order"), F.lit(-1).alias("_mute"), F.lit(0).alias("_shift")),
        F.struct(F.col("shift_from").alias("ts"), F.lit(0).alias("_order"), F.lit(0).alias("_mute"), F.lit(1).alias("_shift")),
    )
    return edits.select("site", F.explode(kinds).alias("_e")).select("site", "_e.*").filter("ts is not null")


def label_wet_bins(
    record: DataFrame,
    interevent_hours: float = 6,
    period_minutes: float = 10,
    edits: DataFrame | None = None,
) -> DataFrame:
    """Wet bins with their ``storm_number`` (from 1 per site).

    A storm ends when at least ``interevent_hours`` stay dry after its last
    wet bin. ``edits`` (``site, mute_from, mute_to, shift_from``) sets the
    bins of a time range to storm 0 and adds one to every later number.

    Dry bins are dropped before anything is sorted. The record is scanned in
    site-months; the months of a site meet only in a table with one row per
    site-month, so a long record is spread over as many tasks as it has months.
    A record that is stored by site and month (:mod:`freshet.sources.buckets`)
    has a ``month``, which spares the shuffle to site-months.
    """
    stored = "month" in record.columns and edits is None
    wet = (
        with_flow_columns(record)
        .filter(is_wet())
        .withColumns({"_order": F.lit(1), "_mute": F.lit(0), "_shift": F.lit(0)})
    )
    if edits is not None:
        wet = wet.unionByName(_edit_marks(edits), allowMissingColumns=True)
    wet = wet.withColumns({"_wet": F.col("_order") == 1, "_month": F.col("month") if stored else month_index("ts")})
    wet = wet.withColumn("_wet", F.col("_wet") & is_wet())
    if not stored:
        wet = cut(wet)  # read twice below; wet bins are a small part of a record

    gap = F.lit(int(round((interevent_hours * 60 + period_minutes) * 60_000_000)))

    def breaks(previous: str, current: str) -> Column:
        return micros_between(previous, current) >= gap

    month = Window.partitionBy("site", "_month").orderBy("ts", "_order")
    upto = month.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.last(F.when(F.col("_wet"), F.col("ts")), ignorenulls=True).over(
        month.rowsBetween(Window.unboundedPreceding, -1)
    )
    scanned = wet.withColumn("_prev", previous).withColumn(
        "_break",
        F.when(F.col("_wet") & F.col("_prev").isNotNull() & breaks("_prev", "ts"), 1).otherwise(0),
    )

    months = scanned.groupBy("site", "_month").agg(
        F.min(F.when(F.col("_wet"), F.col("ts"))).alias("_first"),
        F.max(F.when(F.col("_wet"), F.col("ts"))).alias("_last"),
        *[F.sum(c).alias(f"_sum{c}") for c in ("_break", "_mute", "_shift")],
    )
    in_site = Window.partitionBy("site").orderBy("_month")
    earlier = in_site.rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_prev_last", F.last("_last", ignorenulls=True).over(earlier)).withColumn(
        "_opens",
        F.when(F.col("_first").isNull(), 0)
        .when(F.col("_prev_last").isNull() | breaks("_prev_last", "_first"), 1)
        .otherwise(0),
    )
    offsets = months.select(
        "site",
        "_month",
        (F.coalesce(F.sum(F.col("_opens") + F.col("_sum_break")).over(earlier), F.lit(0)) + F.col("_opens")).alias("_base"),
        F.coalesce(F.sum("_sum_mute").over(earlier), F.lit(0)).alias("_base_mute"),
        F.coalesce(F.sum("_sum_shift").over(earlier), F.lit(0)).alias("_base_shift"),
    )

    number = F.col("_base") + F.sum("_break").over(upto)
    labelled = scanned.join(offsets, ["site", "_month"], "inner")
    if edits is not None:
        muted = F.col("_base_mute") + F.sum("_mute").over(upto) > 0
        shift = F.col("_base_shift") + F.sum("_shift").over(upto)
        number = F.when(muted, F.lit(0)).otherwise(number + shift)
    keep = [c for c in record.columns] + [c for c in (_RAIN, _IN, _OUT) if c not in record.columns]
    return (
        labelled.withColumn("storm_number", number.cast("int"))
        .filter("_wet")
        .select(*keep, "storm_number")
    )


def storm_stats(
    labelled: DataFrame, period_minutes: float = 10, min_precip: float = 0.0, min_flow: float = 0.0
) -> DataFrame:
    """One row per storm from labelled wet bins (label 0 is left out).

    Storms under ``min_precip`` (total depth) or ``min_flow`` (peak outflow
    and inflow) are dropped after numbering and after the dry spell before
    each storm is known.
    """
    secs = epoch_seconds("ts").cast("double")

    def centroid(col: str) -> Column:
        v = F.col(col)
        return F.sum(secs * v) / F.nullif(F.sum(F.when(v.isNotNull(), v)), F.lit(0.0))

    def first_peak(col: str) -> Column:
        # the earliest bin among equal peaks
        return F.max_by("ts", F.when(F.col(col) > 0, F.struct(F.col(col), -epoch_seconds("ts"))))

    def total_volume(col: str) -> Column:
        return F.when(F.max(col) > 0, volumes.flow_volume_m3(F.sum(col), period_minutes))

    stats = (
        labelled.filter("storm_number > 0")
        .groupBy("site", "storm_number")
        .agg(
            F.min("ts").alias("start_date"),
            plus_minutes("max(ts)", period_minutes).alias("end_date"),
            (F.max(_RAIN) * F.lit(60.0 / period_minutes)).alias("peak_precip_intensity"),
            F.sum(_RAIN).alias("total_precip_depth"),
            total_volume(_IN).alias("total_inflow_m3"),
            total_volume(_OUT).alias("total_outflow_m3"),
            F.max(F.when(F.col(_IN) > 0, F.col(_IN))).alias("peak_inflow"),
            F.max(F.when(F.col(_OUT) > 0, F.col(_OUT))).alias("peak_outflow"),
            first_peak(_RAIN).alias("peak_precip_time"),
            first_peak(_OUT).alias("peak_outflow_time"),
            centroid(_RAIN).alias("_rain_centroid"),
            centroid(_OUT).alias("_flow_centroid"),
        )
    )
    # A site has at most one storm per interevent gap, so its storms fit a window.
    in_site = Window.partitionBy("site").orderBy("storm_number")
    stats = (
        stats.withColumn("_prev_end", F.lag("end_date").over(in_site))
        .withColumns(
            {
                "duration_hours": hours_between("start_date", "end_date"),
                "antecedent_days": days_between("_prev_end", "start_date"),
                "peak_lag_hours": hours_between("peak_precip_time", "peak_outflow_time"),
                "centroid_lag_hours": (F.col("_flow_centroid") - F.col("_rain_centroid")) / 3600.0,
            }
        )
        .drop("_prev_end", "_rain_centroid", "_flow_centroid")
    )
    if min_precip > 0:
        stats = stats.filter(F.coalesce("total_precip_depth", F.lit(0.0)) >= min_precip)
    if min_flow > 0:
        stats = stats.filter(F.greatest(F.coalesce("peak_outflow", F.lit(0.0)), F.coalesce("peak_inflow", F.lit(0.0))) >= min_flow)
    return stats


def storm_table(
    stats: DataFrame,
    sites: DataFrame,
    runoff: Column | None = None,
    bypass: Column | None = None,
    inflow: Column | None = None,
    period_minutes: float = 10,
) -> DataFrame:
    """The tidy storm table of all sites (see ``STORM_COLUMNS``).

    ``runoff``, ``bypass`` and ``inflow`` are expressions over the storm and
    the site columns; later ones may read earlier ones (``runoff_m3``...).
    """
    none = F.lit(None).cast("double")
    areas = sites.select("site", "total_area", "impervious_area", "bmp_area")
    table = (
        with_time_groups(stats.join(areas, "site", "inner"), "start_date")
        .withColumn("outflow_m3", F.coalesce("total_outflow_m3", F.lit(0.0)))
        .withColumns(
            {
                "sm_est_peak_inflow": volumes.estimated_peak_inflow(
                    "peak_precip_intensity", "total_area", "impervious_area", "bmp_area", period_minutes
                ),
                "outflow_mm": volumes.outflow_depth("outflow_m3", "total_area", "bmp_area"),
                "has_outflow": volumes.has_outflow("outflow_m3"),
                "runoff_m3": none if runoff is None else runoff,
            }
        )
        .withColumn("bypass_m3", none if bypass is None else bypass)
        .withColumn("inflow_m3", none if inflow is None else inflow)
    )
    return table.select(*STORM_COLUMNS)


def label_record(record: DataFrame, storms: DataFrame) -> DataFrame:
    """Every bin with the storm it falls in; 0 between storms.

    Dry bins inside a storm carry its number, as the wet ones do.
    """
    spans = storms.select(
        "site", "storm_number", F.col("start_date").alias("_start"), F.col("end_date").alias("_end")
    )
    inside = (F.col("ts") >= F.col("_start")) & (F.col("ts") < F.col("_end"))
    return (
        join_on_grid(record, spans, ["site"], day_index("ts"), day_index("_start"), day_index("_end"), inside)
        .withColumn("storm_number", F.coalesce("storm_number", F.lit(0)))
        .drop("_start", "_end")
    )


def override_volumes(storms: DataFrame, overrides: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns of the storms that start on given dates.

    ``overrides`` holds ``site, start_day`` and the columns, one row per
    site and day; its nulls replace too.
    """
    new = overrides.select(
        "site", F.col("start_day").alias("_day"), F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_new_{c}") for c in columns],
    )
    joined = storms.withColumn("_day", F.to_date("start_date")).join(new, ["site", "_day"], "left")
    changed = joined.withColumns(
        {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    )
    return changed.select(*storms.columns)


def as_dates(dates: object) -> list[date]:
    """Dates from one date-like value or several (text, date or datetime)."""
    items = [dates] if isinstance(dates, (str, date)) else list(dates)  # datetime is a date
    out = []
    for d in items:
        if isinstance(d, str):
            d = datetime.fromisoformat(d)
        out.append(d.date() if isinstance(d, datetime) else d)
    return out


def exclude_storms(
    df: DataFrame,
    dates: str | date | Iterable | None,
    datecol: str = "start_date",
    keys: Sequence[str] = ("storm_number",),
) -> DataFrame:
    """Drop every storm with a row on one of the dates.

    With the default keys a storm number is dropped at all sites;
    ``keys=('site', 'storm_number')`` drops it at its own site only.
    """
    if dates is None:
        return df
    hit = df.filter(F.to_date(datecol).isin(as_dates(dates))).select(*keys).distinct()
    return df.join(hit, list(keys), "left_anti").select(*df.columns)


def winsorize(
    df: DataFrame, column: str, limits: DataFrame, by: Sequence[str] = ("site",), group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Clamp a column at rank-based limits of each group.

    ``limits`` holds ``by, low, high``: the shares of a group's values that
    are raised to the smallest, and lowered to the largest, value kept.
    """
    by = list(by)
    ranked = join_small(ranked_values(df, by, column, group_rows=group_rows), limits, by)
    bounds = ranked.groupBy(*by).agg(
        value_at("floor(low * n_total)", column).alias("_low"),
        value_at("(n_total - 1 - floor(high * n_total))", column).alias("_high"),
    )
    clamped = F.least(F.greatest(F.col(column), F.col("_low")), F.col("_high"))
    return (
        join_small(df, bounds, by, "left")
        .withColumn(column, F.when(F.col(column).isNotNull(), clamped))
        .select(*df.columns)
    )
