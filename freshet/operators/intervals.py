"""Point-in-interval joins as equi-joins on grid cells.

Each interval is repeated once per grid cell it touches and each point falls
in one cell, so the join key is (keys, cell). A hot key is spread over its
cells, and, unlike a window, a join may be split further by AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = "_grid"


def over_grid(intervals: DataFrame, first: Column, last: Column) -> DataFrame:
    """Repeat each interval for the grid cells ``first`` to ``last``."""
    return intervals.withColumn(GRID, F.explode(F.sequence(first, last)))


def join_on_grid(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    point_cell: Column,
    first: Column,
    last: Column,
    condition: Column,
    how: str = "left",
) -> DataFrame:
    """Join points to the intervals that hold them.

    ``condition`` reads columns of both sides, which share no names but the
    keys. With ``how='left'`` unmatched points stay, with null intervals.
    """
    right = over_grid(intervals, first, last)
    renamed = right.select(
        *[F.col(k).alias(f"_i_{k}") for k in keys],
        F.col(GRID).alias(f"_i_{GRID}"),
        *[c for c in intervals.columns if c not in keys],
    )
    on = condition & (F.col(GRID) == F.col(f"_i_{GRID}"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_i_{k}"))
    # Spark's size estimate leaves out the repetition, so it would broadcast intervals many times too large
    return (
        points.withColumn(GRID, point_cell)
        .join(renamed.hint("merge"), on, how)
        .drop(GRID, f"_i_{GRID}", *[f"_i_{k}" for k in keys])
    )
