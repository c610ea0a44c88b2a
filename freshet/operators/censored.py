"""Statistics of results with non-detects.

A non-detect is known only to lie below its detection limit. Regression on
order statistics (Helsel & Cohn 1988) gives every observation a plotting
position, fits a line of log value against normal quantile through the
detects, and reads the non-detects off that line.

Write N for the number of observations, N(v) for those below v, c(v) for the
non-detects whose limit is v, and b for N(u) + c(u) at the largest limit u at
or below v (0 if none). The recursion over detection limits telescopes into
    T(v) = product over limits w > v of (1 + c(w) / N(w))
and the plotting positions become
    i-th non-detect at limit v:  T(v)/N * (N(v) + c(v)) * i / (c(v) + 1)
    i-th detect of a bracket:    T(v)/N * (b + A * i / (A + 1))
where A counts the detects of the bracket. T, b and A are running values over
the distinct results, which :mod:`freshet.operators.spread` computes without
gathering a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.numbers import median_ranks, normal_quantile
from freshet.operators.lineage import cut, join_small
from freshet.operators.spread import (
    CELL,
    GROUP_ROWS,
    Running,
    drop_null_keys,
    interpolated,
    numbered,
    quantiles,
    ranked_values,
    running,
    value_at,
)

MIN_DETECTS = 2
MAX_CENSORED = 0.8


def is_nondetect(qualcol: str = "qualifier", ndvals: Sequence[str] = ("<",)) -> Column:
    return F.coalesce(F.col(qualcol).isin(*ndvals), F.lit(False))


def ros_positions(
    df: DataFrame,
    by: Sequence[str],
    rescol: str = "concentration",
    qualcol: str = "qualifier",
    ndvals: Sequence[str] = ("<",),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Plotting position of every observation.

    One row per observation: ``by``, the result, ``censored``, ``position``.
    """
    by = list(by)
    counters = {"_c": is_nondetect(qualcol, ndvals).cast("bigint")}
    ranked = ranked_values(df, by, rescol, counters, group_rows)
    has_limit = F.col("_c") > 0
    below = F.col("n_below").cast("double")
    scanned = running(
        ranked,
        by,
        rescol,
        [
            Running("_base", "max_upto", F.when(has_limit, F.col("n_below") + F.col("_c"))),
            Running("_next", "min_after", F.when(has_limit, F.col("n_below"))),
            Running("_logs", "sum_after", F.when(has_limit & (below > 0), F.log(1 + F.col("_c") / F.nullif(below, F.lit(0.0)))).otherwise(0.0)),
        ],
    )
    if CELL in scanned.columns:  # a long plan that the callers read twice
        scanned = cut(scanned)
    base = F.coalesce("_base", F.lit(0)).cast("double")
    detects = F.coalesce("_next", "n_total").cast("double") - base
    scale = F.exp("_logs") / F.col("n_total")
    # detects of the bracket below this value; at a limit only its non-detects come first
    first = F.greatest(F.col("n_below").cast("double") - base, F.lit(0.0))
    i = F.col("_i")
    nondetect = scale * (F.col("n_below") + F.col("_c")) * i / (F.col("_c") + 1)
    detect = scale * (base + detects * (first + i - F.col("_c")) / (detects + 1))
    each = numbered(scanned, [*by, rescol], "n", "_i")
    return each.select(
        *by,
        rescol,
        (i <= F.col("_c")).alias("censored"),
        F.when(i <= F.col("_c"), nondetect).otherwise(detect).alias("position"),
    )


def ros_values(
    df: DataFrame,
    by: Sequence[str],
    rescol: str = "concentration",
    qualcol: str = "qualifier",
    ndvals: Sequence[str] = ("<",),
    group_rows: int = GROUP_ROWS,
    min_detects: int = MIN_DETECTS,
    max_censored: float = MAX_CENSORED,
) -> DataFrame:
    """Every observation with its estimate ``ros_<rescol>``.

    Detects keep their value. Non-detects take the fitted value, or half their
    limit in groups with fewer than ``min_detects`` detects or a larger share
    of non-detects than ``max_censored``.
    """
    by = list(by)
    placed = ros_positions(df, by, rescol, qualcol, ndvals, group_rows).withColumn(
        "_z", normal_quantile("position")
    )
    detect = ~F.col("censored") & (F.col(rescol) > 0)
    logs, z = F.when(detect, F.log(F.when(detect, F.col(rescol)))), F.when(detect, F.col("_z"))
    fits = placed.groupBy(*by).agg(
        F.regr_slope(logs, z).alias("_slope"),
        F.regr_intercept(logs, z).alias("_intercept"),
        F.count_if(~F.col("censored")).alias("_detects"),
        F.avg(F.col("censored").cast("double")).alias("_share"),
    )
    fitted = F.exp(F.col("_intercept") + F.col("_slope") * F.col("_z"))
    usable = (
        (F.col("_detects") >= min_detects)
        & (F.col("_share") <= max_censored)
        & F.col("_slope").isNotNull()
    )
    estimate = (
        F.when(~F.col("censored"), F.col(rescol)).when(usable, fitted).otherwise(F.col(rescol) * 0.5)
    )
    return join_small(placed, fits, by).select(
        *by, rescol, "censored", "position", estimate.alias(f"ros_{rescol}")
    )


def ros_percentiles(
    df: DataFrame, by: Sequence[str], probs: dict[str, float], rescol: str = "concentration", **options
) -> DataFrame:
    """Percentiles of the ROS estimates per group, one column each."""
    group_rows = options.get("group_rows", GROUP_ROWS)
    return quantiles(ros_values(df, by, rescol, **options), by, f"ros_{rescol}", probs, group_rows)


def _order_bounds(value: str, z: float) -> tuple[Column, Column]:
    """Aggregates: the order statistics that bound the median.

    Their ranks, n/2 -/+ z sqrt(n)/2, are where the bootstrap distribution of
    the median puts its tails as the number of draws grows.
    """
    half = f"{z!r}D * sqrt(n_total) / 2"
    low = f"greatest(floor(n_total / 2 - {half}), 0)"
    high = f"least(ceil(n_total / 2 + {half}) - 1, n_total - 1)"
    return value_at(low, value), value_at(high, value)


def median_bounds(
    df: DataFrame,
    by: Sequence[str],
    rescol: str = "concentration",
    qualcol: str = "qualifier",
    ndvals: Sequence[str] = ("<",),
    bounds: str = "order",
    z: float = 1.96,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """ROS median per group with ``lower`` and ``upper`` bounds.

    ``bounds='order'`` takes the bounding order statistics, ``'notch'`` takes
    ``median -/+ 1.57 IQR / sqrt(n)``.
    """
    by, value = list(by), f"ros_{rescol}"
    ranked = ranked_values(
        ros_values(df, by, rescol, qualcol, ndvals, group_rows), by, value, group_rows=group_rows
    )
    median = interpolated(0.5, value)
    if bounds == "order":
        lower, upper = _order_bounds(value, z)
    elif bounds == "notch":
        iqr = interpolated(0.75, value) - interpolated(0.25, value)
        half = F.lit(1.57) * iqr / F.sqrt(F.max("n_total"))
        lower, upper = median - half, median + half
    else:
        raise ValueError("bounds must be 'order' or 'notch'")
    return ranked.groupBy(*by).agg(
        lower.alias("lower"), median.alias("median"), upper.alias("upper"), F.max("n_total").alias("n")
    )


def bootstrap_median_bounds(
    df: DataFrame,
    by: Sequence[str],
    rescol: str = "concentration",
    qualcol: str = "qualifier",
    ndvals: Sequence[str] = ("<",),
    tail: float = 0.025,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """ROS median per group with the percentile bounds of its bootstrap.

    A resample of n rows draws n ranks; its median is at or below the k-th
    smallest row if enough of them are k or less, which has a binomial
    chance. So the bounds over all resamples are the rows at which that chance
    reaches ``tail`` and ``1 - tail``: ranks that depend on n alone, for groups
    of every size. Of the two middle rows of an even n the lower bound looks
    at the lower one, the upper bound at the upper one.
    """
    by, value = list(by), f"ros_{rescol}"
    ranked = ranked_values(
        ros_values(df, by, rescol, qualcol, ndvals, group_rows), by, value, group_rows=group_rows
    )
    sizes = ranked.select("n_total").distinct().select("n_total", median_ranks("n_total", tail).alias("_ranks"))
    return (
        ranked.join(sizes, "n_total")
        .groupBy(*by)
        .agg(
            value_at("_ranks.low", value).alias("lower"),
            interpolated(0.5, value).alias("median"),
            value_at("_ranks.high", value).alias("upper"),
            F.max("n_total").alias("n"),
        )
    )


def characteristic_effluent(
    df: DataFrame,
    groups: Sequence[str],
    composites: DataFrame,
    rescol: str = "concentration",
    min_samples: int = 10,
    **options,
) -> DataFrame:
    """Typical effluent per site and group.

    Sites with more than ``min_samples`` composite samples get the median and
    its bounds, the others the 5th, 50th and 95th percentiles of the ROS
    estimates. ``composites`` has one row per composite sample.
    """
    by, value = ["site", *[g for g in groups if g != "site"]], f"ros_{rescol}"
    group_rows = options.get("group_rows", GROUP_ROWS)
    ranked = ranked_values(ros_values(df, by, rescol, **options), by, value, group_rows=group_rows)
    lower, upper = _order_bounds(value, 1.96)
    stats = ranked.groupBy(*by).agg(
        lower.alias("_lower"),
        interpolated(0.5, value).alias("effluent_median"),
        upper.alias("_upper"),
        interpolated(0.05, value).alias("_p05"),
        interpolated(0.95, value).alias("_p95"),
    )
    enough = composites.groupBy("site").agg((F.count(F.lit(1)) > min_samples).alias("_enough"))
    return stats.join(enough, "site", "left").select(
        *by,
        F.when(F.col("_enough"), F.col("_lower")).otherwise(F.col("_p05")).alias("effluent_lower"),
        "effluent_median",
        F.when(F.col("_enough"), F.col("_upper")).otherwise(F.col("_p95")).alias("effluent_upper"),
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First non-null value of every other column per key, in a stated order.

    Rows with a null key are left out.
    """
    keys, ordering = list(keys), F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    return (
        drop_null_keys(df, keys)
        .groupBy(*keys)
        .agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), ordering)).alias(c) for c in rest])
    )
