"""Comparison data from outside: scans, medians and the union with own results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import pollutants
from freshet.operators import censored
from freshet.operators.spread import GROUP_ROWS

# --- fixed values: facility categories in use ---
FACILITY_CATEGORIES = (
    "Bioretention", "Detention Basin",
    "Green Roof", "Biofilter",
    "LID", "Manufactured Device",
    "Media Filter", "Porous Pavement",
    "Retention Pond", "Wetland Basin",
    "Wetland Channel",
)

# --- fixed values: key of one land-use observation ---
LANDUSE_KEY = (
    "epa_rain_zone", "location_code", "station_name", "primary_landuse",
    "start_date", "season", "station", "parameter", "units",
)

_LANDUSE_NAMES = [p[2] for p in pollutants.POLLUTANTS if p[2]]
_FACILITY_NAMES = [p[1] for p in pollutants.POLLUTANTS if p[1]]


def landuse_rows(raw: DataFrame, rain_zone: int = 1) -> DataFrame:
    """Total-fraction results of known land uses in one rain zone, renamed."""
    kept = raw.filter(
        (F.col("primary_landuse") != "Unknown")
        & F.col("parameter").isin(*_LANDUSE_NAMES)
        & (F.col("fraction") == "Total")
        & (F.col("epa_rain_zone") == rain_zone)
    )
    renamed = pollutants.rename_external_parameter(kept, "landuse_name")
    return renamed


def landuse_data(raw: DataFrame, order: Sequence[str], rain_zone: int = 1) -> DataFrame:
    """:func:`landuse_rows` with one row per observation key, units corrected.

    ``order`` names the columns that decide which duplicate comes first.
    """
    single = censored.first_per_key(landuse_rows(raw, rain_zone), LANDUSE_KEY, order)
    return pollutants.fix_units(single, pollutants.EXTERNAL_BACTERIA_SPELLINGS)


def facility_data(raw: DataFrame, epa_zone: int = 1, categories: Sequence[str] = FACILITY_CATEGORIES) -> DataFrame:
    """Outflow results of the categories in use in one zone, renamed."""
    kept = raw.filter(
        F.col("category").isin(*categories)
        & F.col("parameter").isin(*_FACILITY_NAMES)
        & (F.col("station") == "outflow")
        & (F.col("epazone") == epa_zone)
    )
    return pollutants.rename_external_parameter(kept, "facility_name")


def _rounded_medians(df: DataFrame, by: list[str], ndvals: Sequence[str], group_rows: int, digits: int = 3) -> DataFrame:
    medians = censored.median_bounds(df, by, "res", "qual", ndvals, group_rows=group_rows)
    return medians.select(*by, *[F.bround(c, digits).alias(c) for c in ("lower", "median", "upper")])


def landuse_medians(
    data: DataFrame, seasonal: bool = False, landuse: str = "Residential", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Medians with bounds of one land use, rounded, overall or by season."""
    by = ["parameter", "units", *(["season"] if seasonal else [])]
    rows = data.filter((F.col("primary_landuse") == landuse) & (F.col("station") == "outflow"))
    return _rounded_medians(rows, by, ("<",), group_rows)


def facility_medians(data: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Medians with bounds by parameter, units and facility category, rounded."""
    return _rounded_medians(data, ["parameter", "units", "category"], ("ND",), group_rows)


def standards_with_medians(standards: DataFrame, **medians: DataFrame) -> DataFrame:
    """Guidelines joined with external medians, columns prefixed by source."""
    out, keys = standards, ["parameter", "units"]
    for source, table in medians.items():
        renamed = table.withColumnsRenamed({c: f"{source}_{c}" for c in ("lower", "median", "upper")})
        out = out.join(renamed, keys, "inner")
    return out


def external_estimates(
    data: DataFrame, site_column: str, ndvals: Sequence[str], group_rows: int = GROUP_ROWS
) -> DataFrame:
    """ROS estimates of external results, the category in ``site``."""
    by = ["parameter", "units", site_column]
    return censored.ros_values(data, by, "res", "qual", ndvals, group_rows).select(
        "parameter", "units", F.col(site_column).alias("site"), F.col("ros_res").alias("concentration")
    )


def combine_wq(wq: DataFrame, estimates: DataFrame) -> DataFrame:
    """Own results and external estimates in one table."""
    cols = ["parameter", "units", "site", "concentration"]
    return wq.select(*cols).unionByName(estimates.select(*cols))
