"""Pieces of SQL used by the check queries."""

from __future__ import annotations

from freshet.functions import numbers


def final(inner: str, keys: str, doubles: str = "", digits: int = 6) -> str:
    """Select ``keys`` as they are and ``doubles`` rounded from a subquery.

    ``inner`` is a table expression; adding zero turns -0.0 into 0.0.
    """
    cols = keys.split() + [f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join(cols)} FROM {inner}"


def _poly(coeffs: tuple[float, ...], x: str) -> str:
    text = f"CAST({coeffs[-1]!r} AS DOUBLE)"
    for c in reversed(coeffs[:-1]):
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text


def normal_quantile(p: str, inner: str) -> str:
    """Subquery adding ``z``, the standard normal quantile of column ``p``."""
    def rational(num: tuple, den: tuple, x: str) -> str:
        return f"{_poly(num, x)} / {_poly(den, x)}"

    centre = rational(numbers.AS241_CENTRE_NUM, numbers.AS241_CENTRE_DEN, "rc")
    middle = rational(numbers.AS241_MIDDLE_NUM, numbers.AS241_MIDDLE_DEN, "(rr - 1.6)")
    far = rational(numbers.AS241_TAIL_NUM, numbers.AS241_TAIL_DEN, "(rr - 5.0)")
    return f"""
        SELECT * EXCLUDE (qq, rc, rr), CASE WHEN abs(qq) <= 0.425 THEN qq * {centre}
            ELSE sign(qq) * (CASE WHEN rr <= 5 THEN {middle} ELSE {far} END) END AS z
        FROM (SELECT *, {p} - 0.5 AS qq, 0.180625 - ({p} - 0.5) * ({p} - 0.5) AS rc,
            sqrt(-ln(CASE WHEN {p} < 0.5 THEN {p} ELSE 1 - {p} END)) AS rr FROM {inner})"""


def ros(source: str, by: str, res: str, nondetect: str) -> dict[str, str]:
    """Named subqueries ending in ``ros``: one row per observation.

    This follows the published recursion over detection limits step by step
    (exceedance probability of each limit, then ranks within brackets).
    """
    b = ", ".join(by.split())

    def same(left: str, right: str) -> str:
        return " AND ".join(f"{left}.{k} = {right}.{k}" for k in by.split())

    known = " AND ".join(f"{k} IS NOT NULL" for k in by.split())
    qualified = ", ".join(f"d.{k}" for k in by.split())
    return {
        "ros_base": f"""
            SELECT {b}, {res} AS v, coalesce({nondetect}, false) AS nd FROM {source}
            WHERE {res} IS NOT NULL AND {known}""",
        "ros_counts": f"""
            SELECT {b}, v, count(*) FILTER (nd) AS c, count(*) FILTER (NOT nd) AS d FROM ros_base GROUP BY ALL""",
        "ros_cumulated": f"""
            SELECT *, sum(c) OVER w AS c_upto, sum(d) OVER w - d AS d_below,
                sum(d) OVER (PARTITION BY {b}) AS d_all
            FROM ros_counts WINDOW w AS (PARTITION BY {b} ORDER BY v)""",
        "ros_limits": f"""
            SELECT *, coalesce(lead(d_below) OVER (PARTITION BY {b} ORDER BY v), d_all) - d_below AS a,
                c_upto + d_below AS bb
            FROM ros_cumulated WHERE c > 0""",
        "ros_exceed": f"""
            SELECT *, coalesce(lead(below) OVER (PARTITION BY {b} ORDER BY v), 1.0) AS next_below
            FROM (SELECT *, exp(sum(ln(bb / CAST(a + bb AS DOUBLE))) OVER (PARTITION BY {b} ORDER BY v
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS below
                FROM ros_limits)""",
        "ros_first": f"""
            SELECT {b}, min(d_below) AS a0, min_by(below, v) AS below0 FROM ros_exceed GROUP BY ALL""",
        "ros_detects": f"""
            SELECT {qualified}, d.v, e.v AS limit_v, coalesce(e.below, 0) AS lo,
                CASE WHEN e.v IS NOT NULL THEN e.next_below ELSE coalesce(f.below0, 1) END AS hi,
                CASE WHEN e.v IS NOT NULL THEN e.a ELSE coalesce(f.a0, t.d_all) END AS a
            FROM (SELECT * FROM ros_base WHERE NOT nd) d
            ASOF LEFT JOIN ros_exceed e ON {same("d", "e")} AND d.v >= e.v
            LEFT JOIN ros_first f ON {same("d", "f")}
            LEFT JOIN (SELECT {b}, max(d_all) AS d_all FROM ros_cumulated GROUP BY ALL) t ON {same("d", "t")}""",
        "ros_positions": f"""
            SELECT {b}, v, false AS censored, lo + (hi - lo) * row_number() OVER
                (PARTITION BY {b}, limit_v ORDER BY v) / (a + 1) AS position
            FROM ros_detects
            UNION ALL
            SELECT {qualified}, d.v, true, e.below * row_number() OVER (PARTITION BY {qualified}, d.v) / (e.c + 1)
            FROM (SELECT * FROM ros_base WHERE nd) d JOIN ros_exceed e ON {same("d", "e")} AND d.v = e.v""",
        "ros_quantiles": normal_quantile("position", "ros_positions"),
        "ros_fits": f"""
            SELECT {b}, regr_slope(ln(v), z) FILTER (NOT censored) AS slope,
                regr_intercept(ln(v), z) FILTER (NOT censored) AS intercept,
                count(*) FILTER (NOT censored) AS detects, avg(CASE WHEN censored THEN 1.0 ELSE 0.0 END) AS share
            FROM ros_quantiles GROUP BY ALL""",
        "ros": f"""
            SELECT {qualified}, v, censored, position, CASE WHEN NOT censored THEN v
                WHEN detects >= 2 AND share <= 0.8 AND slope IS NOT NULL THEN exp(intercept + slope * z)
                ELSE v / 2 END AS r
            FROM ros_quantiles d JOIN ros_fits f ON {same("d", "f")}""",
    }


def order_bounds(source: str, by: str, value: str) -> str:
    """Median with its bounding order statistics per group of a subquery."""
    b = ", ".join(by.split())
    return f"""
        SELECT {b}, min(CASE WHEN rank0 = greatest(floor(n / 2.0 - 1.96 * sqrt(n) / 2), 0) THEN {value} END) AS lower,
            quantile_cont({value}, 0.5) AS median,
            min(CASE WHEN rank0 = least(ceil(n / 2.0 + 1.96 * sqrt(n) / 2) - 1, n - 1) THEN {value} END) AS upper,
            max(n) AS n
        FROM (SELECT {b}, {value}, row_number() OVER (PARTITION BY {b} ORDER BY {value}) - 1 AS rank0,
                count(*) OVER (PARTITION BY {b}) AS n FROM {source})
        GROUP BY ALL"""


def sig_figs(x: str, n: int = 3, expthresh: int = 5) -> str:
    """Text of ``x`` with ``n`` significant figures."""
    arms = []
    for o in range(-expthresh, expthresh + 1):
        digits = n - 1 - o
        fmt = f"format('{{:,.{max(digits, 0)}f}}', round({x}, {digits}))"
        arms.append(f"WHEN floor(log10(abs({x}))) = {o} THEN {fmt}")
    sci = f"format('{{:.{n - 1}e}}', {x})"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN '0.0' {' '.join(arms)} ELSE {sci} END"


def with_units(x: str, units: str, n: int = 3) -> str:
    return f"CASE WHEN {x} IS NULL THEN '--' ELSE {sig_figs(x, n)} || ' ' || {units} END"
