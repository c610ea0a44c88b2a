"""Checks of option values, made before any plan is built."""

from __future__ import annotations

# --- fixed values: names of time groups, sample types and result columns ---
TIME_GROUPS = ("season", "grouped_season", "year", "storm_bin", "samplestart")
SAMPLE_TYPES = ("grab", "composite")
RESULT_UNITS = {"concentration": "units", "load_outflow": "load_units"}


def time_group(name: str | None) -> str | None:
    if name is None:
        return None
    if name.lower() not in TIME_GROUPS:
        raise ValueError(f"{name!r} is not one of the time groups {TIME_GROUPS}")
    return name.lower()


def sample_type(name: str) -> str:
    if name.lower() not in SAMPLE_TYPES:
        raise ValueError(f"{name!r} is not one of the sample types {SAMPLE_TYPES}")
    return name.lower()


def result_column(name: str) -> tuple[str, str]:
    """The result column and the column with its units."""
    if name.lower() not in RESULT_UNITS:
        raise ValueError(f"{name!r} is not one of the result columns {tuple(RESULT_UNITS)}")
    return name.lower(), RESULT_UNITS[name.lower()]
