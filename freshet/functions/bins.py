"""Right-closed value bins with text labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: edges of storm depth bins, mm ---
DEPTH_EDGES = (0, 5, 10, 15, 20, 25, math.inf)


def interval_label(low: float | None, high: float | None, units: str | None = None) -> str:
    """The text of an interval; an end that is None is open, as in ``<5`` and ``>25``."""
    ends = [f"{end}" for end in (low, high) if end is not None]
    sign = "<" if low is None else ">" if high is None else ""
    return " ".join([sign + " - ".join(ends), *([units] if units else [])])


def bin_labels(edges: Sequence[float], units: str | None = None) -> list[str]:
    """Labels of consecutive bins; a bin from zero or to infinity has an open end."""
    ends = [None if edge == 0 or math.isinf(edge) else edge for edge in edges]
    return [interval_label(*pair, units) for pair in zip(ends, ends[1:])]


def _arms(value: str, edges: Sequence[float], results: Sequence[str]) -> str:
    arms = []
    for lo, hi, result in zip(edges[:-1], edges[1:], results, strict=True):
        upper = "" if math.isinf(hi) else f" AND {value} <= {float(hi)!r}D"
        arms.append(f"WHEN {value} > {float(lo)!r}D{upper} THEN {result}")
    return f"CASE {' '.join(arms)} END"


def bin_index(value: str, edges: Sequence[float]) -> Column:
    """Position of the bin ``(lo, hi]`` that holds the value, else null."""
    return F.expr(_arms(value, edges, [str(i) for i in range(len(edges) - 1)]))


def bin_label(value: str, edges: Sequence[float], units: str | None = None) -> Column:
    return F.expr(_arms(value, edges, [f"'{label}'" for label in bin_labels(edges, units)]))


def classify_storms(
    hydro: DataFrame,
    valuecol: str,
    newcol: str = "storm_bin",
    bins: Sequence[float] | None = None,
    units: str = "mm",
) -> DataFrame:
    """Add the bin label of ``valuecol`` and its order, ``<newcol>_idx``."""
    edges = DEPTH_EDGES if bins is None else tuple(bins)
    return hydro.withColumns(
        {newcol: bin_label(valuecol, edges, units), f"{newcol}_idx": bin_index(valuecol, edges)}
    )
