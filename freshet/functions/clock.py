"""Calendar and duration expressions.

Arguments are column names or SQL expressions. Every expression reads the
wall-clock fields of a timestamp, so the results for TIMESTAMP_NTZ columns do
not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEASONS = ("winter", "spring", "summer", "autumn")

# First day (month * 100 + day) of spring, summer, autumn and winter.
SEASON_STARTS = (322, 622, 922, 1222)


def season(ts: str, starts: tuple[int, int, int, int] = SEASON_STARTS) -> Column:
    """Season of a timestamp; null stays null."""
    day = f"month({ts}) * 100 + dayofmonth({ts})"
    spring, summer, autumn, winter = starts
    return F.expr(
        f"CASE WHEN {day} >= {winter} OR {day} < {spring} THEN 'winter' WHEN {day} < {summer} THEN 'spring' "
        f"WHEN {day} < {autumn} THEN 'summer' WHEN {day} < {winter} THEN 'autumn' END"
    )


def grouped_season(ts: str, starts: tuple[int, int, int, int] = SEASON_STARTS) -> Column:
    """Half-year of a timestamp: 'winter/spring' or 'summer/autumn'."""
    day = f"month({ts}) * 100 + dayofmonth({ts})"
    _, summer, _, winter = starts
    return F.expr(
        f"CASE WHEN {day} >= {winter} OR {day} < {summer} THEN 'winter/spring' "
        f"WHEN {day} < {winter} THEN 'summer/autumn' END"
    )


def year_label(ts: str) -> Column:
    """Year as text, the form used in every grouping column."""
    return F.expr(f"CAST(year({ts}) AS STRING)")


def with_time_groups(df: DataFrame, ts: str) -> DataFrame:
    """Add ``season``, ``grouped_season`` and ``year`` taken from ``ts``."""
    return df.withColumns(
        {"season": season(ts), "grouped_season": grouped_season(ts), "year": year_label(ts)}
    )


def _minutes(ts: str) -> str:
    return f"(CAST(unix_date(to_date({ts})) AS BIGINT) * 1440 + hour({ts}) * 60 + minute({ts}))"


def _micros(ts: str) -> str:
    return f"({_minutes(ts)} * 60000000 + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT))"


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970-01-01 of the wall-clock reading (bigint)."""
    return F.expr(_micros(ts))


def epoch_seconds(ts: str) -> Column:
    """Whole seconds since 1970-01-01 of the wall-clock reading (bigint)."""
    return F.expr(f"({_minutes(ts)} * 60 + second({ts}))")


def micros_between(start: str, end: str) -> Column:
    return F.expr(f"({_micros(end)} - {_micros(start)})")


def hours_between(start: str, end: str) -> Column:
    """``end - start`` in hours (double), exact to the microsecond."""
    return F.expr(f"({_micros(end)} - {_micros(start)}) / 3.6e9D")


def days_between(start: str, end: str) -> Column:
    return F.expr(f"({_micros(end)} - {_micros(start)}) / 8.64e10D")


def plus_minutes(ts: str, minutes: float) -> Column:
    return F.expr(f"{ts} + make_dt_interval(0, 0, 0, CAST({float(minutes) * 60} AS DECIMAL(18, 6)))")


def month_index(ts: str) -> Column:
    """Months since year 0, an integer that grows with time."""
    return F.expr(f"year({ts}) * 12 + month({ts}) - 1")


def day_index(ts: str) -> Column:
    """Days since 1970-01-01."""
    return F.expr(f"unix_date(to_date({ts}))")
