"""Plot-ready tables. Each holds aggregates or the points a chart shows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.functions.bins import bin_index, interval_label
from freshet.operators.lineage import join_small
from freshet.operators.spread import GROUP_ROWS, interpolated, numbered, ranked_values

# --- fixed values: sideways shift of each site's error bars ---
SITE_OFFSETS = {"ED-1": 0.0, "LV-2": -0.2, "LV-4": 0.2}

# --- fixed values: storm quantities compared in pairs ---
PAIR_QUANTITIES = (
    "antecedent_days", "duration_hours", "peak_precip_intensity", "total_precip_depth", "outflow_mm",
)
PAIR_HUES = {
    "season": "season", "year": "year", "outflow": "has_outflow", "grouped_season": "grouped_season",
}


def reduction_bars(
    reductions: DataFrame,
    params: Sequence[str],
    xvalue: str,
    offsets: dict[str, float] | None = None,
    lower: str = "load_red_lower",
    reduction: str = "load_red",
    upper: str = "load_red_upper",
) -> DataFrame:
    """Bars with the length of their error bars and their x positions.

    Positions count the x values of a parameter and site from zero. The input
    has one row per site, parameter and x value.
    """
    shift = F.lit(None).cast("double")
    for site, value in (SITE_OFFSETS if offsets is None else offsets).items():
        shift = F.when(F.col("site") == site, F.lit(float(value))).otherwise(shift)
    spot = F.row_number().over(Window.partitionBy("parameter", "site").orderBy(xvalue)) - 1
    return reductions.filter(F.col("parameter").isin(*params)).select(
        "parameter",
        "site",
        xvalue,
        F.col(reduction).alias("y"),
        (F.col(reduction) - F.col(lower)).alias("err_low"),
        (F.col(upper) - F.col(reduction)).alias("err_high"),
        (spot + shift).alias("x"),
    )


def pair_correlations(
    hydro: DataFrame, by: str = "season", quantities: Sequence[str] = PAIR_QUANTITIES
) -> DataFrame:
    """Correlation of every pair of quantities per site and hue."""
    hue = PAIR_HUES[by]
    pairs = [(a, b) for i, a in enumerate(quantities) for b in quantities[i + 1 :]]
    both = {(a, b): F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs}
    wide = (
        hydro.na.drop(subset=["site", hue])
        .groupBy("site", F.col(hue).alias("hue"))
        .agg(
            *[F.corr(a, b).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)],
            *[F.count_if(both[p]).alias(f"n_{i}") for i, p in enumerate(pairs)],
        )
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("xcol"), F.lit(b).alias("ycol"), F.col(f"n_{i}").alias("points"), F.nanvl(F.col(f"r_{i}"), F.lit(None)).alias("r"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select("site", "hue", F.explode(rows).alias("_p")).select("site", "hue", "_p.*")


def pair_bins(
    hydro: DataFrame, steps: dict[str, float], hues: Sequence[str] = tuple(PAIR_HUES)
) -> DataFrame:
    """Storms per cell of every pair of quantities, by site and hue, in one pass.

    ``steps`` has the cell width of each quantity. Rows name the hue and the
    pair they belong to; storms without one of the two quantities are left out.
    """
    names = list(steps)
    cells = {q: F.floor(F.col(q) / F.lit(float(s))) * F.lit(float(s)) for q, s in steps.items()}
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("xcol"), F.lit(b).alias("ycol"), cells[a].alias("x_from"), cells[b].alias("y_from"))
            for i, a in enumerate(names)
            for b in names[i + 1 :]
        ]
    )
    tints = F.array(*[F.struct(F.lit(h).alias("hue_name"), F.col(PAIR_HUES[h]).cast("string").alias("hue")) for h in hues])
    paired = hydro.select("site", tints.alias("_hues"), F.explode(pairs).alias("_pair")).filter(
        "_pair.x_from IS NOT NULL AND _pair.y_from IS NOT NULL"
    )
    counted = paired.groupBy("site", "_hues", "_pair").agg(F.count(F.lit(1)).alias("storms"))
    return (
        counted.select("site", F.explode("_hues").alias("_hue"), "_pair", "storms")
        .groupBy("site", "_hue.hue_name", "_hue.hue", "_pair.xcol", "_pair.ycol", "_pair.x_from", "_pair.y_from")
        .agg(F.sum("storms").alias("storms"))
    )


def storm_histogram(
    hydro: DataFrame,
    valuecol: str = "total_precip_depth",
    edges: Sequence[float] = (5, 10, 15, 20, 25),
    facets: Sequence[str] = ("site",),
    units: str | None = None,
) -> DataFrame:
    """Storms per value bin and facet; the outer bins are open."""
    v = F.col(valuecol)
    labels = [interval_label(*pair, units) for pair in zip([None, *edges], [*edges, None])]
    idx = F.when(v <= edges[0], 0).otherwise(bin_index(valuecol, (*edges, math.inf)) + 1)
    label = F.lit(None).cast("string")
    for i, text in enumerate(labels):
        label = F.when(F.col("bin_idx") == i, text).otherwise(label)
    return (
        hydro.withColumn("bin_idx", idx)
        .filter("bin_idx is not null")
        .groupBy(*facets, "bin_idx")
        .agg(F.count(F.lit(1)).alias("storms"))
        .withColumn("bin", label)
    )


def joint_counts(
    hydro: DataFrame,
    xcol: str,
    ycol: str,
    xstep: float,
    ystep: float,
    conditions: str | Column | None = None,
    site: str | None = None,
) -> DataFrame:
    """Counts over a grid of (x, y) per site, the data of a joint plot.

    ``conditions`` is SQL, or a Column such as :func:`freshet.functions.conditions.condition` makes.
    """
    df = hydro if site is None else hydro.filter(F.col("site") == site)
    if conditions is not None:
        df = df.filter(F.expr(conditions) if isinstance(conditions, str) else conditions)

    def lower_edge(c: str, step: float) -> Column:
        return F.floor(F.col(c) / F.lit(float(step))) * F.lit(float(step))

    return (
        df.na.drop(subset=[xcol, ycol])
        .groupBy("site", lower_edge(xcol, xstep).alias("x_from"), lower_edge(ycol, ystep).alias("y_from"))
        .agg(F.count(F.lit(1)).alias("storms"))
    )


def box_stats(
    df: DataFrame,
    by: Sequence[str] = ("parameter", "site"),
    value: str = "concentration",
    params: Sequence[str] | None = None,
    sites: Sequence[str] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR) and outlier counts."""
    by = list(by)
    if params is not None:
        df = df.filter(F.col("parameter").isin(*params))
    if sites is not None:
        df = df.filter(F.col("site").isin(*sites))
    # ranked values are one row per distinct value, and already spread
    ranked = ranked_values(df, by, value, group_rows=group_rows)
    quartiles = ranked.groupBy(*by).agg(
        *[interpolated(p, value).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    )
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        join_small(ranked, quartiles, by)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("count"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
        )
    )


def ts_points(
    wq: DataFrame, datecol: str, ycol: str, sites: Sequence[str], params: Sequence[str]
) -> DataFrame:
    """The points of a time series chart."""
    return (
        wq.filter(F.col("site").isin(*sites) & F.col("parameter").isin(*params))
        .na.drop(subset=[ycol])
        .select("parameter", "site", datecol, ycol)
    )


def probability_positions(
    df: DataFrame, value: str, by: Sequence[str] = ("parameter", "site"), group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Sorted values with their plotting position in percent (Filliben).

    The first and last positions are ``1 - 0.5^(1/n)`` and ``0.5^(1/n)``, the
    others ``(i - 0.3175) / (n + 0.365)``. Equal values take successive positions.
    """
    by = list(by)
    each = numbered(ranked_values(df, by, value, group_rows=group_rows), [*by, value], "n", "_i")
    i, n = F.col("n_below") + F.col("_i"), F.col("n_total")
    tail = F.pow(F.lit(0.5), F.lit(1.0) / n)
    position = F.when(i == n, tail).when(i == 1, 1 - tail).otherwise((i - 0.3175) / (n + 0.365))
    return each.select(*by, value, (position * 100).alias("probability"))

