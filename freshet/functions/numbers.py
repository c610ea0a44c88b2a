"""Numeric expressions: ratios that never raise, report formats, normal quantile.

Text arguments are column names or SQL expressions.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import workers

# --- fixed values: coefficients of algorithm AS241 (Wichura 1988), PPND16 ---
AS241_CENTRE_NUM = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
)
AS241_CENTRE_DEN = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
)
AS241_MIDDLE_NUM = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
AS241_MIDDLE_DEN = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
)
AS241_TAIL_NUM = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
AS241_TAIL_DEN = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
)
# --- end of fixed values ---


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null where ``den`` is zero (ANSI division would raise)."""
    return num / F.nullif(den, F.lit(0.0))


def pct_reduction(inflow: Column | str, outflow: Column | str) -> Column:
    """Percent of the inflow that is held back: ``100 * (in - out) / in``."""
    i = F.col(inflow) if isinstance(inflow, str) else inflow
    o = F.col(outflow) if isinstance(outflow, str) else outflow
    return ratio(F.lit(100.0) * (i - o), i)


def _poly(coeffs: tuple[float, ...], x: str) -> str:
    text = f"{coeffs[-1]!r}D"
    for c in reversed(coeffs[:-1]):
        text = f"({text} * {x} + {c!r}D)"
    return text


def normal_quantile(p: str) -> Column:
    """Standard normal quantile of ``p`` (null outside the open interval 0..1)."""
    q, tail = f"({p} - 0.5D)", f"least({p}, 1D - {p})"
    rc, r = f"(0.180625D - {q} * {q})", f"sqrt(-ln({tail}))"
    centre = f"{q} * {_poly(AS241_CENTRE_NUM, rc)} / {_poly(AS241_CENTRE_DEN, rc)}"
    middle = f"{_poly(AS241_MIDDLE_NUM, f'({r} - 1.6D)')} / {_poly(AS241_MIDDLE_DEN, f'({r} - 1.6D)')}"
    far = f"{_poly(AS241_TAIL_NUM, f'({r} - 5D)')} / {_poly(AS241_TAIL_DEN, f'({r} - 5D)')}"
    return F.expr(
        f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425D THEN {centre} "
        f"ELSE signum({q}) * CASE WHEN {r} <= 5 THEN {middle} ELSE {far} END END"
    )


def _sig_figs(v: str, n: int, expthresh: int) -> str:
    if n < 1:
        raise ValueError("n must be at least 1")
    order = f"floor(log10(abs({v})))"
    up, down = f"pow(10D, {n - 1} - {order})", f"pow(10D, {order} - {n - 1})"
    return (
        f"CASE WHEN {v} = 0 THEN '0.0' WHEN {order} NOT BETWEEN {-expthresh} AND {expthresh} "
        f"THEN format_string('%.{n - 1}e', {v}) WHEN {order} < {n} "
        f"THEN format_number(round({v} * {up}) / {up}, CAST({n - 1} - {order} AS INT)) "
        f"WHEN {v} IS NOT NULL THEN format_number(round({v} / {down}) * {down}, 0) END"
    )


def sig_figs(x: str, n: int = 3, expthresh: int = 5) -> Column:
    """Text with ``n`` significant figures and thousands separators.

    Magnitudes beyond ``10 ** expthresh`` (either way) are written in
    scientific form; null stays null. Ties round away from zero.
    """
    return F.expr(_sig_figs(x, n, expthresh))


def with_units(x: str, units: str, n: int = 3) -> Column:
    """``'0.120 mg/L'``; a missing value is written ``'--'``."""
    return F.expr(f"CASE WHEN {x} IS NULL THEN '--' ELSE concat_ws(' ', {_sig_figs(x, n, 5)}, {units}) END")


def _chance_at_least(n: int, r: int, p: float) -> float:
    """P(Bin(n, p) >= r), by the continued fraction of the incomplete beta function."""
    if p >= 1 or r <= 0:
        return 1.0
    a, b, x = float(r), float(n - r + 1), p
    swapped = x > (a + 1) / (a + b + 2)
    if swapped:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            total *= c * d
        if abs(c * d - 1) < 1e-15 or m > 1_000_000:
            return 1 - front * total if swapped else front * total


def bootstrap_rank(n: int, r: int, level: float) -> int:
    """The smallest 0-based rank that the r-th smallest of n redrawn rows reaches with a chance of ``level``."""
    low, high = 1, n
    while low < high:
        k = (low + high) // 2
        low, high = (low, k) if _chance_at_least(n, r, k / n) >= level else (k + 1, high)
    return low - 1


def bca_levels(n: int, below: int, upto: int, acceleration: float, tail: float) -> tuple[float, float]:
    """The levels of the bootstrap distribution at which bias-corrected, accelerated bounds of a median lie.

    ``below`` and ``upto`` count the rows below the median and up to it.
    """
    chances = [_chance_at_least(n, r, k / n) for r in ((n + 1) // 2, n // 2 + 1) for k in (below, upto) if k]
    share = min(max(sum(chances) / 4, 1e-300), 1 - 1e-16)
    normal = NormalDist()
    bias = normal.inv_cdf(share)

    def level(z: float) -> float:
        room = 1 - acceleration * (bias + z)
        return normal.cdf(bias + (bias + z) / room) if room > 0 else float(z > 0)

    return level(normal.inv_cdf(tail)), level(normal.inv_cdf(1 - tail))


def bca_ranks(size: str, below: str, upto: str, acceleration: str, tail: float) -> Column:
    """``struct<low, high>``: 0-based ranks of the rows at the levels of :func:`bca_levels`."""
    workers.ship(SparkSession.active())

    @F.arrow_udf(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
    def ranks(sizes: pa.Array, belows: pa.Array, uptos: pa.Array, accelerations: pa.Array) -> pa.Array:
        low, high = [], []
        for n, lt, le, a in zip(*(x.to_pylist() for x in (sizes, belows, uptos, accelerations))):
            first, last = bca_levels(n, lt, le, a, tail)
            low.append(bootstrap_rank(n, (n + 1) // 2, first))
            high.append(bootstrap_rank(n, n // 2 + 1, last))
        return pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["low", "high"])

    return ranks(*[F.col(c).cast("long") for c in (size, below, upto)], F.col(acceleration))


def median_ranks(size: str, tail: float) -> Column:
    """``struct<low, high>``: 0-based ranks of the rows that bound the median of ``size`` redrawn rows."""
    workers.ship(SparkSession.active())

    @F.arrow_udf(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
    def ranks(sizes: pa.Array) -> pa.Array:
        ns = sizes.to_pylist()
        low = [bootstrap_rank(n, (n + 1) // 2, tail) for n in ns]
        high = [bootstrap_rank(n, n // 2 + 1, 1 - tail) for n in ns]
        return pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["low", "high"])

    return ranks(F.col(size).cast("long"))
