"""Summary tables over the tidy data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions import options
from freshet.functions.numbers import pct_reduction, ratio, sig_figs
from freshet.operators.lineage import cut
from freshet.operators.spread import (
    GROUP_ROWS,
    drop_null_keys,
    interpolated,
    near_ranks,
    quantiles,
    rank_of,
)
from freshet.operators.storms import as_dates, exclude_storms

LOADS = tuple(
    f"load_{part}{bound}"
    for part in ("runoff", "bypass", "inflow", "outflow")
    for bound in ("_lower", "", "_upper")
)

# --- fixed values: report headings of load_totals (unclosed brackets included) ---
LOAD_TOTAL_HEADINGS = {
    "load_runoff_lower": "Runoff Load (lower bound)",
    "load_runoff": "Runoff Load",
    "load_runoff_upper": "Runoff Load (upper bound",
    "load_bypass_lower": "Bypass Load (lower bound)",
    "load_bypass": "Bypass Load",
    "load_bypass_upper": "Bypass Load (upper bound",
    "load_inflow_lower": "Estimated Total Influent Load (lower bound)",
    "load_inflow": "Estimated Total Influent Load",
    "load_inflow_upper": "Estimated Total Influent Load (upper bound",
    "load_outflow_lower": "Total Effluent Load (lower bound)",
    "load_outflow": "Total Effluent Load",
    "load_outflow_upper": "Total Effluent Load (upper bound",
    "reduct_mass_lower": "Load Reduction Mass (lower bound)",
    "reduct_mass": "Load Reduction Mass",
    "reduct_mass_upper": "Load Reduction Mass (upper bound)",
    "reduct_pct_lower": "Load Reduction Percent (lower bound)",
    "reduct_pct": "Load Reduction Percent",
    "reduct_pct_upper": "Load Reduction Percent (upper bound)",
}

# --- fixed values: report headings of wq_summary ---
WQ_SUMMARY_HEADINGS = {
    "count": "Count",
    "count_nds": "Count of Non-detects",
    "mean": "Mean",
    "std": "Standard Deviation",
    "cov": "Coeff. of Variation",
    "min": "Minimum",
    "p10": "10th Percentile",
    "p25": "25th Percentile",
    "p50": "Median",
    "p75": "75th Percentile",
    "p90": "90th Percentile",
    "max": "Maximum",
}

# --- fixed values: temporal groupings of the report sets ---
GROUPINGS = {
    "Overall": None,
    "By Year": "year",
    "By Season": "season",
    "By Grouped Season": "grouped_season",
    "By Storm Size": "storm_bin",
}


def _by(fixed: Sequence[str], groupby_col: str | None) -> list[str]:
    """Group keys of a report: its own and a time group."""
    time = options.time_group(groupby_col)
    return [*fixed, *([time] if time else [])]


def _times(groupings: dict[str, str | None] | None) -> list[str]:
    return list(dict.fromkeys(c for c in (groupings or GROUPINGS).values() if c))


def roll_up(
    finest: DataFrame, by: Sequence[str], sums: Sequence[str], groupings: dict[str, str | None] | None = None
) -> DataFrame:
    """Sums at the finest key, rolled up to every grouping.

    ``finest`` has ``sums`` per ``by`` and time columns of the ``groupings``,
    and is cheap to read again (see :func:`freshet.operators.lineage.cut`).
    Each grouping gives rows with the keys ``grouping`` and ``group_value``: the
    time column's value as text, "All" overall. A row counts in every grouping
    whose value it has. What is read per grouping are sums, not rows.
    """
    levels = []
    for name, column in (groupings or GROUPINGS).items():
        level = finest if column is None else finest.filter(F.col(column).isNotNull())
        value = F.lit("All") if column is None else F.col(column).cast("string")
        keyed = level.select(*by, F.lit(name).alias("grouping"), value.alias("group_value"), *sums)
        levels.append(keyed.groupBy(*by, "grouping", "group_value").agg(*[F.sum(c).alias(c) for c in sums]))
    return reduce(DataFrame.unionAll, levels)


_CELL = ["grouping", "group_value"]


def prevalence_counts(wq: DataFrame, rescol: str = "concentration", groupby_col: str | None = None) -> DataFrame:
    """Composite results per site [and time] and parameter, whatever parameters there are."""
    by = _by(["site"], groupby_col)
    composite = drop_null_keys(wq.filter(F.col("sampletype") == "composite"), [*by, "parameter"])
    return composite.groupBy(*by, "parameter").agg(F.count(rescol).alias("n"))


def prevalence_at_groupings(
    wq: DataFrame, rescol: str = "concentration", groupings: dict[str, str | None] | None = None
) -> DataFrame:
    """:func:`prevalence_counts` at several temporal groupings, from one count (see :func:`roll_up`)."""
    composite = drop_null_keys(wq.filter(F.col("sampletype") == "composite"), ["site", "parameter"])
    finest = composite.groupBy("site", "parameter", *_times(groupings)).agg(F.count(rescol).alias("n"))
    return roll_up(cut(finest), ["site", "parameter"], ["n"], groupings).select("site", *_CELL, "parameter", "n")


def prevalence_table(
    wq: DataFrame,
    rescol: str = "concentration",
    groupby_col: str | None = None,
    parameters: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`prevalence_counts` with one column per parameter.

    Naming the ``parameters`` spares the pass that finds them; others then have no column.
    """
    by = _by(["site"], groupby_col)
    counts = prevalence_counts(wq, rescol, groupby_col)
    pivoted = counts.groupBy(*by).pivot("parameter", list(parameters) if parameters else None)
    return pivoted.agg(F.first("n"))


def remove_load_data(
    wq: DataFrame, dates: object, datecol: str, keep_meta: bool = False
) -> DataFrame:
    """Null every ``load_*`` column on the dates.

    This takes ``load_units`` and ``load_factor`` along, so such rows leave
    the groupings by load units; ``keep_meta=True`` spares those two.
    """
    hit = F.to_date(datecol).isin(as_dates(dates))
    spared = {"load_units", "load_factor"} if keep_meta else set()
    return wq.select(
        *[
            F.when(hit, None).otherwise(F.col(c)).alias(c)
            if c.startswith("load_") and c not in spared
            else F.col(c)
            for c in wq.columns
        ]
    )


def load_reduction_pct(
    wq: DataFrame,
    groupby_col: str | None = None,
    load_inflow: str = "load_inflow",
    load_outflow: str = "load_outflow",
    load_inflow_lower: str = "load_inflow_lower",
    load_inflow_upper: str = "load_inflow_upper",
    load_outflow_lower: str = "load_outflow_lower",
    load_outflow_upper: str = "load_outflow_upper",
) -> DataFrame:
    """Percent load reduction of summed loads.

    The lower bound sets the low influent against the high effluent, the
    upper bound the reverse. Groups without all three values are left out.
    """
    by = _by(["site", "parameter", "load_units"], groupby_col)
    cols = {
        "_in": load_inflow, "_in_lo": load_inflow_lower, "_in_hi": load_inflow_upper,
        "_out": load_outflow, "_out_lo": load_outflow_lower, "_out_hi": load_outflow_upper,
    }
    sums = drop_null_keys(wq, by).groupBy(*by).agg(*[F.sum(c).alias(a) for a, c in cols.items()], F.count(F.lit(1)).alias("count"))
    return _reduction_pct(sums, by)


def load_reduction_at_groupings(wq: DataFrame, groupings: dict[str, str | None] | None = None) -> DataFrame:
    """:func:`load_reduction_pct` at several temporal groupings, from one summation (see :func:`roll_up`)."""
    by = ["site", "parameter", "load_units"]
    cols = {f"_{side}{short}": f"load_{side}flow{bound}" for side in ("in", "out") for short, bound in (("", ""), ("_lo", "_lower"), ("_hi", "_upper"))}
    finest = drop_null_keys(wq, by).groupBy(*by, *_times(groupings)).agg(
        *[F.sum(c).alias(a) for a, c in cols.items()], F.count(F.lit(1)).alias("count")
    )
    return _reduction_pct(roll_up(cut(finest), by, [*cols, "count"], groupings), [*by, *_CELL])


def _reduction_pct(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    return sums.select(
        *by,
        pct_reduction("_in", "_out").alias("load_red"),
        pct_reduction("_in_lo", "_out_hi").alias("load_red_lower"),
        pct_reduction("_in_hi", "_out_lo").alias("load_red_upper"),
        "count",
    ).na.drop(subset=["load_red", "load_red_lower", "load_red_upper"])


def reduction_ranges(reductions: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Reduction ranges as text, ``lower - upper``, one column per parameter."""
    text = F.concat_ws(" - ", sig_figs("load_red_lower", 2), sig_figs("load_red_upper", 2))
    return (
        reductions.filter(F.col("parameter").isin(*parameters))
        .groupBy("site")
        .pivot("parameter", list(parameters))
        .agg(F.first(text))
    )


def load_summary_table(wq: DataFrame) -> DataFrame:
    """Loads as text, ``load (lower; upper)``, by parameter.

    One influent and one effluent column per kind of storm (unsampled without
    outflow, unsampled with outflow, sampled) and the overall reduction.
    """
    kinds = {"unsampled_no": ("unsampled", "No"), "unsampled_yes": ("unsampled", "Yes"), "composite_yes": ("composite", "Yes")}
    parts = [f"load_{p}{b}" for p in ("inflow", "outflow") for b in ("", "_lower", "_upper")]

    def text(prefix: str):
        return F.format_string("%s (%s; %s)", *[sig_figs(prefix + b, 3, 7) for b in ("", "_lower", "_upper")])

    by = ["parameter", "units", "has_outflow", "sampletype"]
    loads = (
        drop_null_keys(wq, by)
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in parts])
        .na.drop(subset=parts)
    )
    cells = []
    for name, (sampletype, outflow) in kinds.items():
        hit = (F.col("sampletype") == sampletype) & (F.col("has_outflow") == outflow)
        effluent = text("load_outflow")
        if name == "unsampled_no":
            effluent = F.lit("0")
        elif name == "composite_yes":
            effluent = sig_figs("load_outflow", 3, 7)
        cells += [
            F.max(F.when(hit, text("load_inflow"))).alias(f"influent_{name}"),
            F.max(F.when(hit, effluent)).alias(f"effluent_{name}"),
        ]
    totals = loads.groupBy("parameter").agg(*cells, *[F.sum(c).alias(c) for c in parts])
    reduced = totals.withColumns(
        {
            "load_red": pct_reduction("load_inflow", "load_outflow"),
            "load_red_lower": pct_reduction("load_inflow_lower", "load_outflow_upper"),
            "load_red_upper": pct_reduction("load_inflow_upper", "load_outflow_lower"),
        }
    )
    names = [f"{side}_{k}" for k in kinds for side in ("influent", "effluent")]
    filled = {"effluent_unsampled_no": F.lit("0")}
    return reduced.select(
        "parameter", *[filled.get(c, F.col(c)).alias(c) for c in names], text("load_red").alias("reduction")
    )


def storm_stats(
    hydro: DataFrame,
    minprecip: float = 0,
    excluded_dates: object = None,
    groupby_col: str | None = None,
    exclude_keys: Sequence[str] = ("storm_number",),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Descriptive statistics of every numeric storm quantity, one row each.

    Storms must exceed ``minprecip``. A ``year`` kept as a number is described
    like any other quantity; the storm number is not.
    """
    by = _by(["site"], groupby_col)
    long = _quantities(hydro, by, by, minprecip, excluded_dates, exclude_keys)
    return _describe(long, [*by, "quantity"], "value", _STORM_POINTS, group_rows)


def storm_stats_at_groupings(
    hydro: DataFrame,
    minprecip: float = 0,
    excluded_dates: object = None,
    exclude_keys: Sequence[str] = ("storm_number",),
    group_rows: int = GROUP_ROWS,
    groupings: dict[str, str | None] | None = None,
) -> DataFrame:
    """:func:`storm_stats` at several temporal groupings, in one pass."""
    times = _times(groupings)
    long = _quantities(hydro, ["site", *times], ["site"], minprecip, excluded_dates, exclude_keys)
    return _describe_at_groupings(long, ["site", "quantity"], "value", _STORM_POINTS, group_rows, {}, groupings)


_STORM_POINTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _quantities(
    hydro: DataFrame, keys: Sequence[str], known: Sequence[str], minprecip: float, excluded_dates: object, exclude_keys: Sequence[str]
) -> DataFrame:
    """Storms over ``minprecip`` as rows of ``quantity`` and ``value``; the ``known`` keys are not null."""
    numeric = [
        f.name
        for f in hydro.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in {*keys, "storm_number"}
    ]
    kept = drop_null_keys(
        exclude_storms(hydro, excluded_dates, "start_date", exclude_keys).filter(
            F.col("total_precip_depth") > minprecip
        ),
        known,
    )
    return kept.select(*keys, *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot(
        list(keys), numeric, "quantity", "value"
    )


def _describe_at_groupings(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], group_rows: int, counters: dict[str, Column], groupings: dict[str, str | None] | None
) -> DataFrame:
    """:func:`_describe` at several groupings: a row is passed on once for each, to sums in the same task."""
    cells = [
        F.struct(F.lit(name).alias("grouping"), (F.lit("All") if column is None else F.col(column).cast("string")).alias("group_value"))
        for name, column in (groupings or GROUPINGS).items()
    ]
    sums = {f"_counted_{name}": c for name, c in counters.items()}
    rows = drop_null_keys(df, by).select(*by, F.explode(F.array(*cells)).alias("_cell"), value, *[c.alias(name) for name, c in sums.items()])
    named = rows.select(*by, "_cell.*", value, *sums).filter(F.col("group_value").isNotNull())
    return _describe(named, [*by, *_CELL], value, probs, group_rows, {name: F.col(f"_counted_{name}") for name in counters})


def _describe(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float],
    group_rows: int,
    counters: dict[str, Column] | None = None,
) -> DataFrame:
    """Count, mean, sd, min, percentiles and max of ``value`` per group.

    The rows are read twice: for sums, and for the few values around the percentiles.
    """
    totals = {
        **{name: F.sum(c) for name, c in (counters or {}).items()},
        "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "std": F.stddev_samp(value),
    }
    groups, ranked = near_ranks(df, by, value, [rank_of(p) for p in probs.values()], totals, group_rows)
    points = ranked.groupBy(*by).agg(*[interpolated(p, value).alias(name) for name, p in probs.items()])
    named = groups.withColumnRenamed("n_total", "count").join(points, by, "left")
    return named.select(*by, "count", *(counters or {}), "mean", "min", "max", *probs, "std")


_WQ_POINTS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def wq_summary(
    wq: DataFrame,
    rescol: str = "concentration",
    sampletype: str = "composite",
    groupby_col: str | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Concentration or load statistics per site, parameter [and time].

    Any qualifier but ``=`` counts as a non-detect, a missing one included.
    """
    rescol, unitscol = options.result_column(rescol)
    by = _by(["site", "parameter", unitscol], groupby_col)
    stats = _describe(_of_type(wq, sampletype, by), by, rescol, _WQ_POINTS, group_rows, _nondetects())
    return stats.withColumn("cov", ratio(F.col("std"), F.col("mean"))).select(*by, *WQ_SUMMARY_HEADINGS)


def wq_summary_at_groupings(
    wq: DataFrame,
    rescol: str = "concentration",
    sampletype: str = "composite",
    group_rows: int = GROUP_ROWS,
    groupings: dict[str, str | None] | None = None,
) -> DataFrame:
    """:func:`wq_summary` at several temporal groupings, in one pass."""
    rescol, unitscol = options.result_column(rescol)
    by = ["site", "parameter", unitscol]
    stats = _describe_at_groupings(_of_type(wq, sampletype, by), by, rescol, _WQ_POINTS, group_rows, _nondetects(), groupings)
    return stats.withColumn("cov", ratio(F.col("std"), F.col("mean"))).select(*by, *_CELL, *WQ_SUMMARY_HEADINGS)


def _of_type(wq: DataFrame, sampletype: str, by: Sequence[str]) -> DataFrame:
    return drop_null_keys(wq.filter(F.col("sampletype") == options.sample_type(sampletype)), by)


def _nondetects() -> dict[str, Column]:
    return {"count_nds": (~F.col("qualifier").eqNullSafe(F.lit("="))).cast("bigint")}


def load_totals(wq: DataFrame, groupby_col: str | None = None, na_value: float | None = 0.0) -> DataFrame:
    """Summed loads with reductions in mass and percent, and their bounds.

    Sums without any load become ``na_value``; None leaves them null. A
    reduction of a zero influent load has no percentage.
    """
    by = _by(["site", "parameter", "sampletype", "has_outflow", "load_units"], groupby_col)
    total = (lambda c: F.sum(c)) if na_value is None else (lambda c: F.coalesce(F.sum(c), F.lit(float(na_value))))
    sums = drop_null_keys(wq, by).groupBy(*by).agg(*[total(c).alias(c) for c in LOADS])
    return load_reductions(sums).select(*by, *LOAD_TOTAL_HEADINGS)


def load_totals_at_groupings(
    wq: DataFrame, time_columns: Sequence[str] = ("year", "season", "grouped_season", "storm_bin"), na_value: float = 0.0
) -> DataFrame:
    """:func:`load_totals` overall and by each time column, in one pass.

    The finest sums are taken once, before the shuffle; the grouping sets are
    sums of those.
    """
    by = ["site", "parameter", "sampletype", "has_outflow", "load_units"]
    times = list(time_columns)
    finest = (
        drop_null_keys(wq, by).groupBy(*by, *times).agg(*[F.sum(c).alias(c) for c in LOADS])
    )
    sets = [by] + [[*by, t] for t in times]
    sums = finest.groupingSets([[F.col(c) for c in s] for s in sets], *[*by, *times]).agg(
        F.grouping_id(*by, *times).alias("_gid"), *[F.sum(c).alias(c) for c in LOADS]
    )
    # a set that keeps a time column has a 0 in its bit; there the key must be known
    width = len(times)
    grouping = F.lit("overall")
    known = F.lit(True)
    for i, t in enumerate(times):
        kept = F.col("_gid").bitwiseAND(F.lit(1 << (width - 1 - i))) == 0
        grouping = F.when(kept, t).otherwise(grouping)
        known = known & (~kept | F.col(t).isNotNull())
    filled = sums.withColumn("grouping", grouping).filter(known).withColumns(
        {c: F.coalesce(c, F.lit(float(na_value))) for c in LOADS}
    )
    return load_reductions(filled).select("grouping", *by, *times, *LOAD_TOTAL_HEADINGS)


def load_reductions(sums: DataFrame) -> DataFrame:
    """Add reductions in mass and percent to summed loads, bounds crossed."""
    bounds = {"_lower": "_upper", "": "", "_upper": "_lower"}
    masses = sums.withColumns(
        {f"reduct_mass{i}": F.col(f"load_inflow{i}") - F.col(f"load_outflow{o}") for i, o in bounds.items()}
    )
    return masses.withColumns(
        {f"reduct_pct{i}": ratio(F.col(f"reduct_mass{i}"), F.col(f"load_inflow{i}")) * 100.0 for i in bounds}
    )


def sample_counts(df: DataFrame, seasons: Sequence[str]) -> DataFrame:
    """Rows per parameter, one column per season."""
    return (
        drop_null_keys(df, ["parameter", "season"])
        .groupBy("parameter")
        .pivot("season", list(seasons))
        .agg(F.count(F.lit(1)))
    )


def plain_medians(
    df: DataFrame,
    rescol: str = "concentration",
    by: Sequence[str] = ("season", "parameter", "units"),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Medians that take non-detects at face value."""
    return quantiles(df, list(by), rescol, {"median": 0.5}, group_rows)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of several columns, as ``field, value`` rows."""
    pairs = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "field", "value"
    )
    return pairs.filter("value is not null").distinct()


def collect_sites(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tidy tables that were made per site."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def with_headings(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    """Rename columns to their report headings."""
    return df.withColumnsRenamed({c: h for c, h in headings.items() if c in df.columns})
