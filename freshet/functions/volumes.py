"""Runoff, flow and load expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.functions.pollutants import LITERS_PER_CUBICMETER, MILLIMETERS_PER_METER


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def simple_method(depth, total_area, impervious_area, bmp_area, conversion: float = 1.0) -> Column:
    """Runoff volume of a rain depth over a drainage area (Schueler 1987).

    Depth in mm and areas in m2 give litres; ``conversion=0.001`` gives m3.
    """
    total = _c(total_area)
    coefficient = F.lit(0.05) + F.lit(0.9) * _c(impervious_area) / F.nullif(total, F.lit(0.0))
    return _c(depth) * (total * coefficient + _c(bmp_area)) * F.lit(float(conversion))


def estimated_peak_inflow(
    peak_intensity, total_area, impervious_area, bmp_area, period_minutes: float = 10
) -> Column:
    """Peak inflow (L/s) if the peak intensity (mm/h) lasts one period."""
    depth = _c(peak_intensity) * F.lit(period_minutes / 60.0)
    litres = simple_method(depth, total_area, impervious_area, bmp_area)
    return litres * F.lit(1.0 / (60.0 * period_minutes))


def outflow_depth(outflow_m3, total_area, bmp_area) -> Column:
    """Outflow as a depth (mm) over the drainage area."""
    return (
        _c(outflow_m3)
        / F.nullif(_c(total_area) + _c(bmp_area), F.lit(0.0))
        * F.lit(MILLIMETERS_PER_METER)
    )


def has_outflow(outflow_m3, threshold: float = 0.1) -> Column:
    """'Yes' when more than ``threshold`` m3 left the site, else 'No'."""
    return F.when(_c(outflow_m3) > threshold, "Yes").otherwise("No")


def linear_volume(
    const: float = 0.0,
    intensity: float = 0.0,
    depth: float = 0.0,
    duration: float = 0.0,
    intensity_col: str = "peak_precip_intensity",
    depth_col: str = "total_precip_depth",
    duration_col: str = "duration_hours",
) -> Column:
    """``max(0, const + intensity*I + depth*D + duration*T)``; zero terms are left out."""
    value = F.lit(float(const))
    for coef, name in ((intensity, intensity_col), (depth, depth_col), (duration, duration_col)):
        if coef:
            value = value + F.lit(float(coef)) * F.col(name)
    return F.greatest(F.lit(0.0), value)


def power_volume(
    const: float = 0.0,
    intensity: float = 0.0,
    depth: float = 0.0,
    intensity_col: str = "peak_precip_intensity",
    depth_col: str = "total_precip_depth",
) -> Column:
    """``10 ** (const + intensity*I + depth*D)``; zero terms are left out."""
    exponent = F.lit(float(const))
    for coef, name in ((intensity, intensity_col), (depth, depth_col)):
        if coef:
            exponent = exponent + F.lit(float(coef)) * F.col(name)
    return F.pow(F.lit(10.0), exponent)


def net_volume(runoff, bypass) -> Column:
    """``max(0, runoff - bypass)``."""
    return F.greatest(F.lit(0.0), _c(runoff) - _c(bypass))


def by_site(expressions: dict[str, Column], sitecol: str = "site", default: Column | None = None) -> Column:
    """One expression per site; sites without one take ``default`` (null)."""
    rest = F.lit(None).cast("double") if default is None else default
    cases = F
    for site, expr in expressions.items():
        cases = cases.when(F.col(sitecol) == F.lit(site), expr)
    return cases.otherwise(rest) if expressions else rest


def flow_volume_m3(flow_sum, period_minutes: float) -> Column:
    """Volume (m3) of summed flow readings (L/s) taken every period."""
    return _c(flow_sum) * F.lit(60.0 * period_minutes / LITERS_PER_CUBICMETER)


def load(factor, volume, concentration, backup=None) -> Column:
    """Pollutant load; ``backup`` stands in for a missing concentration."""
    conc = _c(concentration) if backup is None else F.coalesce(_c(concentration), _c(backup))
    return _c(factor) * _c(volume) * conc
