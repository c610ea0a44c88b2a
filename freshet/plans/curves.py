"""What curves of long records need: points thinned to a drawing's width, and smooth densities from counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions.clock import epoch_micros
from freshet.operators.spread import drop_null_keys

#: Standard deviations beyond which a Gaussian is below the precision of a double.
REACH = 9


def _number(df: DataFrame, x: str) -> tuple[Column, bool]:
    """The axis as a number, and whether it is a whole one: times are microseconds."""
    kind = df.schema[x].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return epoch_micros(x), True
    if isinstance(kind, T.IntegralType):
        return F.col(x).cast("long"), True
    return F.col(x).cast("double"), False


def thinned_points(points: DataFrame, by: Sequence[str], x: str, y: str, width: int) -> DataFrame:
    """The points of each series that draw its line at ``width`` pixel columns (M4, Jugel et al. 2014).

    The span of a series is cut into ``width`` equal columns; of each, the
    first, last, lowest and highest point are kept, four rows at most. Whatever
    is drawn between them falls on the pixels of the line through all points.
    Of equal ends the smallest and the largest ``y`` count, of equal extremes
    the earliest and the latest. Rows without ``x``, ``y`` or a key are left
    out; repeated points come once. Both aggregations merge before the shuffle.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    by = list(by)
    number, whole = _number(points, x)
    known = drop_null_keys(points, by).na.drop(subset=[x, y]).select(*by, x, y, number.alias("_x"))
    spans = known.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    if whole:
        pixel = F.expr(f"(_x - _lo) * {width}L DIV (_hi - _lo + 1)")
    else:
        pixel = F.expr(f"CASE WHEN _hi > _lo THEN least(floor((_x - _lo) / (_hi - _lo) * {width}), {width - 1}) ELSE 0 END")
    along, across = F.struct("_x", y, x), F.struct(y, "_x", x)
    kept = known.join(spans, by).groupBy(*by, pixel.alias("_pixel")).agg(
        F.min(along).alias("first"), F.max(along).alias("last"), F.min(across).alias("low"), F.max(across).alias("high")
    )
    ends = F.array(*[F.struct(f"{e}.{x}", f"{e}.{y}") for e in ("first", "last", "low", "high")])
    return kept.select(*by, F.explode(F.array_distinct(ends)).alias("_p")).select(*by, f"_p.{x}", f"_p.{y}")


def _scott(df: DataFrame, by: Sequence[str], axes: dict[str, float], bandwidths: dict[str, float] | None) -> DataFrame:
    """``by``, ``_n`` and the bandwidth ``_h_<axis>`` of each axis: Scott's rule, or one cell where all values are alike."""
    power = -1 / (len(axes) + 4)
    spread = {
        q: F.lit(float(bandwidths[q])) if bandwidths and q in bandwidths else F.stddev_samp(q) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(power))
        for q in axes
    }
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.when(h > 0, h), F.lit(float(axes[q]))).alias(f"_h_{q}") for q, h in spread.items()]
    )


def density(
    df: DataFrame, by: Sequence[str], axes: dict[str, float], bandwidths: dict[str, float] | None = None
) -> DataFrame:
    """Gaussian kernel density per group on a grid: ``by``, the centre of a cell on each axis, ``density``.

    ``axes`` has the cell width of one or two quantities (any number works).
    Rows are counted per cell before the shuffle; then one axis after the other
    is smoothed, each cell giving its share to the cells in reach, since the
    kernel of several axes is a product. The work grows with the cells, not
    with the rows. ``bandwidths`` are by Scott's rule where none is given. Rows
    without a quantity or a key are left out.
    """
    if any(step <= 0 for step in axes.values()) or any(h <= 0 for h in (bandwidths or {}).values()):
        raise ValueError("cell widths and bandwidths must be above zero")
    by, names = list(by), list(axes)
    known = drop_null_keys(df, by).na.drop(subset=names).select(*by, *[F.col(q).cast("double").alias(q) for q in names])
    cell = {q: F.floor(F.col(q) / F.lit(float(step))).cast("long").alias(f"_i_{q}") for q, step in axes.items()}
    cells = known.groupBy(*by, *cell.values()).agg(F.count(F.lit(1)).cast("double").alias("_m"))
    smooth = cells.join(_scott(known, by, axes, bandwidths), by)
    fixed = [*by, "_n", *[f"_h_{q}" for q in names]]
    for q, step in axes.items():
        h = F.col(f"_h_{q}") / F.lit(float(step))  # in cells
        reach = F.ceil(h * REACH).cast("long")
        offset = F.col("_offset").cast("double") / h
        weight = F.exp(-offset * offset / 2) / (F.col(f"_h_{q}") * F.lit(math.sqrt(2 * math.pi)))
        rest = [f"_i_{other}" for other in names if other != q]
        smooth = (
            smooth.withColumn("_offset", F.explode(F.sequence(-reach, reach)))
            .groupBy(*fixed, *rest, (F.col(f"_i_{q}") + F.col("_offset")).alias(f"_i_{q}"))
            .agg(F.sum(F.col("_m") * weight).alias("_m"))
        )
    centres = [((F.col(f"_i_{q}") + 0.5) * F.lit(float(step))).alias(q) for q, step in axes.items()]
    return smooth.select(*by, *centres, (F.col("_m") / F.col("_n")).alias("density"))
