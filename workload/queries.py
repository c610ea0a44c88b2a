"""Every operator as a query over the given tables, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.functions import bins, clock, conditions, pollutants, volumes
from freshet.functions.numbers import sig_figs
from freshet.operators import censored, hydro, lineage, refresh, resampling, samples, sketches, storms
from freshet.operators.lineage import cut
from freshet.operators.spread import quantiles
from freshet.plans import charts, curves, external, quality, reports, summaries
from workload import oracle
from workload.oracle import final
from workload.views import GRID_MINUTES, LOADS, LOOKBACK_HOURS, PARAMETERS, Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PARAMS = [p[0] for p in PARAMETERS.values()]
METALS = ["Cadmium (Cd)", "Copper (Cu)", "Zinc (Zn)"]
SEASONS = ["winter", "spring", "summer", "autumn"]
EXCLUDED = ["1998-07-08", "1999-03-02"]
_TEMPLATE = [(p[0], p[3]) for p in pollutants.POLLUTANTS]
_IN_METALS = "('Cadmium (Cd)', 'Copper (Cu)', 'Zinc (Zn)')"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order cannot show."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, digits: int = 6, **subqueries: str):
    """Register a query; ``sql`` is its check, with extra named subqueries."""

    def register(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Views(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = with_views(sql, **subqueries)
        return fn

    return register


# --- loads -------------------------------------------------------------------

_SUMS = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in summaries.LOADS)
_TOTALS = " ".join(summaries.LOAD_TOTAL_HEADINGS)
_LOAD_BY = "site parameter sampletype has_outflow load_units"


def _totals(extra: str = "") -> str:
    keys = ", ".join(f"{_LOAD_BY} {extra}".split())
    return f"""(SELECT *, reduct_mass_lower / nullif(load_inflow_lower, 0) * 100 AS reduct_pct_lower,
            reduct_mass / nullif(load_inflow, 0) * 100 AS reduct_pct,
            reduct_mass_upper / nullif(load_inflow_upper, 0) * 100 AS reduct_pct_upper
        FROM (SELECT *, load_inflow_lower - load_outflow_upper AS reduct_mass_lower,
                load_inflow - load_outflow AS reduct_mass, load_inflow_upper - load_outflow_lower AS reduct_mass_upper
            FROM (SELECT {keys}, {_SUMS} FROM {{src}} WHERE parameter IS NOT NULL AND load_units IS NOT NULL
                GROUP BY ALL)))""".replace("{src}", "v_wq")


@query("load_totals", final(_totals(), _LOAD_BY, _TOTALS))
def _(v: Views) -> DataFrame:
    return summaries.load_totals(v.wq)


@query("load_totals_by_season", final(_totals("season"), f"{_LOAD_BY} season", _TOTALS))
def _(v: Views) -> DataFrame:
    return summaries.load_totals(v.wq, "season")


_TIMES = ("year", "season", "grouped_season", "storm_bin")
_DEPTH_BIN = "CASE " + " ".join(
    f"WHEN total_precip_depth > {low} AND total_precip_depth <= {high if high != float('inf') else '1e300'} THEN '{label}'"
    for low, high, label in zip(bins.DEPTH_EDGES, bins.DEPTH_EDGES[1:], bins.bin_labels(bins.DEPTH_EDGES, "mm"))
) + " END"
_SIZED = f"(SELECT *, {_DEPTH_BIN} AS storm_bin FROM v_wq)"


def _sized(v: Views) -> DataFrame:
    """The tidy rows with the bin of their storm's depth."""
    return bins.classify_storms(v.wq, "total_precip_depth", "storm_bin").drop("storm_bin_idx")


def _grouped_totals() -> str:
    parts = []
    for tag in ("overall", *_TIMES):
        cols = ", ".join(t if t == tag else f"CAST(NULL AS VARCHAR) AS {t}" for t in _TIMES)
        rounds = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _TOTALS.split())
        totals = _totals("" if tag == "overall" else tag).replace("FROM v_wq", f"FROM {_SIZED}")
        known = "" if tag == "overall" else f" WHERE {tag} IS NOT NULL"
        parts.append(f"SELECT '{tag}' AS grouping, {', '.join(_LOAD_BY.split())}, {cols}, {rounds} FROM {totals}{known}")
    return " UNION ALL ".join(parts)


@query("load_totals_at_groupings", _grouped_totals())
def _(v: Views) -> DataFrame:
    return summaries.load_totals_at_groupings(_sized(v), list(_TIMES))


_PCT = """(SELECT {keys}, 100 * (sum(load_inflow) - sum(load_outflow)) / nullif(sum(load_inflow), 0) AS load_red,
    100 * (sum(load_inflow_lower) - sum(load_outflow_upper)) / nullif(sum(load_inflow_lower), 0) AS load_red_lower,
    100 * (sum(load_inflow_upper) - sum(load_outflow_lower)) / nullif(sum(load_inflow_upper), 0) AS load_red_upper,
    count(*) AS count FROM {src} WHERE parameter IS NOT NULL AND load_units IS NOT NULL GROUP BY ALL
    HAVING sum(load_inflow) <> 0 AND sum(load_inflow_lower) <> 0 AND sum(load_inflow_upper) <> 0)"""
_PCT_SEASON = _PCT.format(keys="site, parameter, load_units, season", src="v_wq")


@query(
    "load_reduction_pct",
    final(_PCT.format(keys="site, parameter, load_units", src="v_wq"), "site parameter load_units count", "load_red load_red_lower load_red_upper"),
)
def _(v: Views) -> DataFrame:
    return summaries.load_reduction_pct(v.wq)


@query(
    "load_reduction_pct_by_season",
    final(_PCT_SEASON, "site parameter load_units season count", "load_red load_red_lower load_red_upper"),
)
def _(v: Views) -> DataFrame:
    return summaries.load_reduction_pct(v.wq, "season")


@query(
    "reduction_ranges",
    "SELECT site, "
    + ", ".join(
        f"max(CASE WHEN parameter = '{p}' THEN {oracle.sig_figs('load_red_lower', 2)} || ' - ' || "
        f"{oracle.sig_figs('load_red_upper', 2)} END) AS \"{p}\""
        for p in METALS
    )
    + f" FROM {_PCT.format(keys='site, parameter, load_units', src='v_wq')} WHERE parameter IN {_IN_METALS} GROUP BY site",
)
def _(v: Views) -> DataFrame:
    return summaries.reduction_ranges(summaries.load_reduction_pct(v.wq), METALS)


def _load_summary_sql() -> str:
    def text(prefix: str) -> str:
        return " || ".join(
            [oracle_text(prefix), "' ('", oracle_text(prefix + "_lower"), "'; '", oracle_text(prefix + "_upper"), "')'"]
        )

    def oracle_text(c: str) -> str:
        return f"({oracle.sig_figs(c, 3, 7)})"

    cells = []
    for name, st, out in (("unsampled_no", "unsampled", "No"), ("unsampled_yes", "unsampled", "Yes"), ("composite_yes", "composite", "Yes")):
        hit = f"sampletype = '{st}' AND has_outflow = '{out}'"
        cells.append(f"max(CASE WHEN {hit} THEN {text('load_inflow')} END) AS influent_{name}")
        effl = {"unsampled_no": "'0'", "composite_yes": oracle_text("load_outflow")}.get(name, text("load_outflow"))
        cells.append(f"max(CASE WHEN {hit} THEN {effl} END) AS effluent_{name}")
    names = [c.rsplit(" AS ", 1)[1] for c in cells]
    sums = ", ".join(f"sum({c}) AS {c}" for c in summaries.LOADS if "flow" in c)
    return f"""
        SELECT parameter, {", ".join(n if n != "effluent_unsampled_no" else "'0' AS " + n for n in names)},
            {text("load_red")} AS reduction
        FROM (SELECT *, 100 * (load_inflow - load_outflow) / nullif(load_inflow, 0) AS load_red,
                100 * (load_inflow_lower - load_outflow_upper) / nullif(load_inflow_lower, 0) AS load_red_lower,
                100 * (load_inflow_upper - load_outflow_lower) / nullif(load_inflow_upper, 0) AS load_red_upper
            FROM (SELECT parameter, {", ".join(cells)}, {sums}
                FROM (SELECT parameter, units, has_outflow, sampletype, {sums} FROM v_wq
                    WHERE parameter IS NOT NULL AND units IS NOT NULL GROUP BY ALL)
                GROUP BY parameter))"""


@query("load_summary", _load_summary_sql())
def _(v: Views) -> DataFrame:
    return summaries.load_summary_table(v.wq)


_LOAD_COLS = " ".join(LOADS)


@query(
    "remove_loads",
    final(
        "(SELECT * REPLACE ("
        + ", ".join(
            f"CASE WHEN CAST(start_date AS DATE) IN ('1998-07-08', '1999-03-02') THEN NULL ELSE {c} END AS {c}"
            for c in ["load_units", "load_factor", *LOADS]
        )
        + ") FROM v_wq)",
        "site parameter sampletype storm_number start_date load_units",
        f"concentration load_factor {_LOAD_COLS}",
    ),
)
def _(v: Views) -> DataFrame:
    kept = "site parameter sampletype storm_number start_date load_units concentration load_factor"
    return summaries.remove_load_data(v.wq, EXCLUDED, "start_date").select(*kept.split(), *LOADS)


# --- concentration and storm statistics ----------------------------------------

_STATS = "mean std cov min p10 p25 p50 p75 p90 max"


def _wq_summary_sql(res: str, units: str, extra: str = "", source: str = "v_wq") -> str:
    keys = f"site parameter {units} {extra}"
    return final(
        f"""(SELECT {", ".join(keys.split())}, count({res}) AS count,
            count(*) FILTER (qualifier IS DISTINCT FROM '=') AS count_nds, avg({res}) AS mean,
            stddev_samp({res}) AS std, stddev_samp({res}) / nullif(avg({res}), 0) AS cov, min({res}) AS min,
            quantile_cont({res}, 0.1) AS p10, quantile_cont({res}, 0.25) AS p25, quantile_cont({res}, 0.5) AS p50,
            quantile_cont({res}, 0.75) AS p75, quantile_cont({res}, 0.9) AS p90, max({res}) AS max
        FROM {source} WHERE sampletype = 'composite' AND parameter IS NOT NULL AND {units} IS NOT NULL GROUP BY ALL)""",
        f"{keys} count count_nds",
        _STATS,
    )


@query("wq_summary", _wq_summary_sql("concentration", "units"))
def _(v: Views) -> DataFrame:
    return summaries.wq_summary(v.wq)


@query("wq_summary_by_season", _wq_summary_sql("concentration", "units", "season"))
def _(v: Views) -> DataFrame:
    return summaries.wq_summary(v.wq, groupby_col="season")


@query("wq_summary_loads_by_year", _wq_summary_sql("load_outflow", "load_units", "year"))
def _(v: Views) -> DataFrame:
    return summaries.wq_summary(v.wq, "load_outflow", groupby_col="year")


def _prevalence(extra: str) -> str:
    return f"""SELECT site, {extra}, parameter, count(concentration) AS n FROM v_wq
        WHERE sampletype = 'composite' AND parameter IS NOT NULL AND {extra} IS NOT NULL GROUP BY ALL"""


@query("prevalence_by_season", _prevalence("season"))
def _(v: Views) -> DataFrame:
    return summaries.prevalence_counts(v.wq, groupby_col="season")


@query("prevalence_by_sample", _prevalence("samplestart"))
def _(v: Views) -> DataFrame:
    return summaries.prevalence_counts(v.wq, groupby_col="samplestart")


_QUANTITIES = ("duration_hours", "total_precip_depth", "peak_precip_intensity", "outflow_mm", "antecedent_days")


def _storm_stats_sql(source: str, time: str = "season") -> str:
    keys = ", ".join(time.split())
    parts = " UNION ALL ".join(f"SELECT site, {keys}, '{q}' AS quantity, {q} AS value FROM kept" for q in _QUANTITIES)
    return final(
        f"""(WITH kept AS (SELECT * FROM {source} WHERE total_precip_depth > 1.9999 AND storm_number NOT IN
                (SELECT storm_number FROM {source} WHERE CAST(start_date AS DATE) IN ('1998-07-08', '1999-03-02')))
            SELECT site, {keys}, quantity, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std,
                min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS p25,
                quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75
            FROM ({parts}) GROUP BY ALL)""",
        f"site {time} quantity count",
        "mean std min max p25 p50 p75",
    )


@query("storm_stats", _storm_stats_sql("v_storms"))
def _(v: Views) -> DataFrame:
    return summaries.storm_stats(v.storms, 1.9999, EXCLUDED, "season")


def _all_groupings(source: str) -> str:
    """SQL of the rows of every grouping, with its name and value."""
    parts = ["SELECT *, 'Overall' AS grouping, 'All' AS group_value FROM sized"]
    for name, column in summaries.GROUPINGS.items():
        if column:
            parts.append(f"SELECT *, '{name}' AS grouping, CAST({column} AS VARCHAR) AS group_value FROM sized WHERE {column} IS NOT NULL")
    return f"WITH sized AS (SELECT *, {_DEPTH_BIN} AS storm_bin FROM {source}) {' UNION ALL '.join(parts)}"


_GROUPED = {"v_grouped": _all_groupings("v_wq")}
_GROUP_KEYS = "grouping group_value"


@query(
    "prevalence_at_groupings",
    """SELECT site, grouping, group_value, parameter, count(concentration) AS n FROM v_grouped
        WHERE sampletype = 'composite' AND parameter IS NOT NULL GROUP BY ALL""",
    **_GROUPED,
)
def _(v: Views) -> DataFrame:
    return summaries.prevalence_at_groupings(_sized(v))


@query(
    "load_reduction_at_groupings",
    final(
        _PCT.format(keys=f"site, parameter, load_units, {', '.join(_GROUP_KEYS.split())}", src="v_grouped"),
        f"site parameter load_units {_GROUP_KEYS} count", "load_red load_red_lower load_red_upper",
    ),
    **_GROUPED,
)
def _(v: Views) -> DataFrame:
    return summaries.load_reduction_at_groupings(_sized(v))


@query("wq_summary_at_groupings", _wq_summary_sql("concentration", "units", _GROUP_KEYS, "v_grouped"), **_GROUPED)
def _(v: Views) -> DataFrame:
    return summaries.wq_summary_at_groupings(_sized(v))


@query(
    "storm_stats_at_groupings",
    _storm_stats_sql("v_grouped_storms", _GROUP_KEYS),
    v_grouped_storms=_all_groupings("v_storms"),
)
def _(v: Views) -> DataFrame:
    sized = bins.classify_storms(v.storms, "total_precip_depth", "storm_bin").drop("storm_bin_idx")
    return summaries.storm_stats_at_groupings(sized, 1.9999, EXCLUDED)


_WINSOR = """SELECT * REPLACE (least(greatest(duration_hours, lo), hi) AS duration_hours) FROM (SELECT s.*, b.lo, b.hi
    FROM v_storms s JOIN (
        SELECT site, min(CASE WHEN i = floor(low * n) THEN duration_hours END) AS lo,
            min(CASE WHEN i = n - 1 - floor(high * n) THEN duration_hours END) AS hi
        FROM (SELECT x.site, duration_hours, row_number() OVER (PARTITION BY x.site ORDER BY duration_hours) - 1 AS i,
                count(*) OVER (PARTITION BY x.site) AS n, low, high
            FROM v_storms x JOIN v_limits l ON x.site = l.site)
        GROUP BY site) b ON s.site = b.site)"""
_LIMITS = """SELECT site, CAST(CASE site WHEN 'S1' THEN 0.2 WHEN 'S2' THEN 0.2 ELSE 0 END AS DOUBLE) AS low,
    CAST(CASE site WHEN 'S1' THEN 0.1 WHEN 'S2' THEN 0.3 ELSE 0 END AS DOUBLE) AS high
    FROM (SELECT DISTINCT site FROM v_storms)"""


def _limits(v: Views) -> DataFrame:
    return v.storms.select("site").distinct().selectExpr(
        "site",
        "CAST(CASE site WHEN 'S1' THEN 0.2 WHEN 'S2' THEN 0.2 ELSE 0 END AS DOUBLE) AS low",
        "CAST(CASE site WHEN 'S1' THEN 0.1 WHEN 'S2' THEN 0.3 ELSE 0 END AS DOUBLE) AS high",
    )


@query("winsorize", final("v_winsorized", "site storm_number", "duration_hours"), v_limits=_LIMITS, v_winsorized=_WINSOR)
def _(v: Views) -> DataFrame:
    return storms.winsorize(v.storms, "duration_hours", _limits(v)).select("site", "storm_number", "duration_hours")


@query("winsorized_storm_stats", _storm_stats_sql("v_winsorized"), v_limits=_LIMITS, v_winsorized=_WINSOR)
def _(v: Views) -> DataFrame:
    clamped = storms.winsorize(v.storms, "duration_hours", _limits(v))
    return summaries.storm_stats(clamped, 1.9999, EXCLUDED, "season")


_BIN_CASE = " ".join(
    f"WHEN total_precip_depth > {lo} AND total_precip_depth <= {hi if hi != float('inf') else 'CAST(1e308 AS DOUBLE)'} THEN {{{i}}}"
    for i, (lo, hi) in enumerate(zip(bins.DEPTH_EDGES[:-1], bins.DEPTH_EDGES[1:]))
)
_BIN_LABELS = ["<5 mm", "5 - 10 mm", "10 - 15 mm", "15 - 20 mm", "20 - 25 mm", ">25 mm"]


@query(
    "classify_storms",
    "SELECT site, storm_number, CASE "
    + _BIN_CASE.format(*[f"'{x}'" for x in _BIN_LABELS])
    + " END AS storm_bin, CASE "
    + _BIN_CASE.format(*[f"CAST({i} AS INT)" for i in range(6)])
    + " END AS storm_bin_idx FROM v_storms",
)
def _(v: Views) -> DataFrame:
    return bins.classify_storms(v.storms, "total_precip_depth").select("site", "storm_number", "storm_bin", "storm_bin_idx")


@query(
    "exclude_storms",
    """SELECT site, storm_number, start_date FROM v_storms WHERE storm_number NOT IN
        (SELECT storm_number FROM v_storms WHERE CAST(start_date AS DATE) IN ('1998-07-08', '1999-03-02'))""",
)
def _(v: Views) -> DataFrame:
    return storms.exclude_storms(v.storms, EXCLUDED).select("site", "storm_number", "start_date")


@query(
    "sample_counts",
    "SELECT parameter, "
    + ", ".join(f"nullif(count(*) FILTER (season = '{s}'), 0) AS {s}" for s in SEASONS)
    + " FROM v_wq WHERE parameter IS NOT NULL GROUP BY 1",
)
def _(v: Views) -> DataFrame:
    return summaries.sample_counts(v.wq, SEASONS)


_SKETCHED = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
_SKETCH_BY = ["site", "parameter", "units", "season"]


@query(
    "sketched_percentiles_by_season",
    final(
        f"""(SELECT {", ".join(_SKETCH_BY)}, count(*) AS n, min(concentration) AS min, max(concentration) AS max,
            {", ".join(f"true AS {p}_near" for p in _SKETCHED)} FROM v_wq
        WHERE sampletype = 'composite' AND parameter IS NOT NULL AND concentration IS NOT NULL GROUP BY ALL)""",
        f"{' '.join(_SKETCH_BY)} n {' '.join(f'{p}_near' for p in _SKETCHED)}", "min max",
    ),
)
def _(v: Views) -> DataFrame:
    """Sketches by site and day, rolled up to seasons; a percentile is near if its rank is off by twice the usual error at most."""
    rows = v.wq.filter("sampletype = 'composite'")
    daily = cut(sketches.sketch_values(rows, _SKETCH_BY[:3], "concentration")).withColumn("season", clock.season("day"))
    found = cut(sketches.approx_percentiles(sketches.merge_sketches(daily, _SKETCH_BY), _SKETCH_BY, _SKETCHED))
    errors = sketches.rank_errors(rows, _SKETCH_BY, "concentration", found, _SKETCHED)
    near = [(F.col(p) <= 2 * sketches.rank_error()).alias(f"{p}_near") for p in _SKETCHED]
    return found.select(*_SKETCH_BY, "n", "min", "max").join(errors.select(*_SKETCH_BY, *near), _SKETCH_BY)


_MEDIANS = """(SELECT season, parameter, units, quantile_cont(concentration, 0.5) AS median FROM v_wq
    WHERE sampletype = 'composite' AND parameter IS NOT NULL AND concentration IS NOT NULL GROUP BY ALL)"""


@query("season_medians", final(_MEDIANS, "season parameter units", "median"))
def _(v: Views) -> DataFrame:
    return summaries.plain_medians(v.wq.filter("sampletype = 'composite'"))


@query(
    "distinct_values",
    "SELECT DISTINCT field, value FROM (SELECT 'site' AS field, site AS value FROM v_wq UNION ALL SELECT 'parameter', parameter FROM v_wq "
    "UNION ALL SELECT 'sampletype', sampletype FROM v_wq) WHERE value IS NOT NULL",
)
def _(v: Views) -> DataFrame:
    return summaries.distinct_values(v.wq, ["site", "parameter", "sampletype"])


# --- sensor records and storms -----------------------------------------------------


@query("resample_10min", final("v_bins", "site ts", "head_mm precip_mm"))
def _(v: Views) -> DataFrame:
    return v.bins


def _dense(minutes: int) -> dict[str, str]:
    """SQL of the dense record: every bin from a site's first to its last."""
    return dict(
        sql=final(
            f"""(SELECT s.site, s.ts, b.head_mm, b.precip_mm FROM (
                SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL '{minutes} minutes')) AS ts FROM v_sparse GROUP BY 1) s
            LEFT JOIN v_sparse b ON s.site = b.site AND s.ts = b.ts)""",
            "site ts",
            "head_mm precip_mm",
        ),
        v_sparse=f"""SELECT r.site, time_bucket(INTERVAL '{minutes} minutes', ts, TIMESTAMP '1970-01-01') AS ts,
            avg(level_mm - weir_height_mm) AS head_mm, sum(precip_mm) AS precip_mm
            FROM v_readings r JOIN v_sites s ON r.site = s.site GROUP BY 1, 2""",
    )


def _dense_bins(v: Views, minutes: int) -> DataFrame:
    return hydro.fill_bins(hydro.resample(hydro.head_above_weir(v.readings, v.sites), minutes), minutes)


@query("resample_dense", **_dense(60))
def _(v: Views) -> DataFrame:
    return _dense_bins(v, 60)


@query("resample_dense_10min", **_dense(10))
def _(v: Views) -> DataFrame:
    return _dense_bins(v, 10)


@query("resample_dense_7min", **_dense(7))
def _(v: Views) -> DataFrame:
    """A period that does not divide a day."""
    return _dense_bins(v, 7)


@query(
    "gauged_raw",
    final("v_raw_gauged", "site ts", "precip_mm head_mm"),
    v_raw_bins="SELECT site, ts, avg(level_mm) AS level_mm, sum(precip_mm) AS precip_mm FROM v_readings GROUP BY 1, 2",
    v_raw_gauged="""SELECT coalesce(p.site, h.site) AS site, coalesce(p.ts, h.ts) AS ts, p.precip_mm, h.head_mm
        FROM (SELECT s.site, b.ts, b.precip_mm FROM v_raw_bins b JOIN v_sites s ON b.site = s.raingauge) p
        FULL JOIN (SELECT b.site, b.ts, level_mm - weir_height_mm AS head_mm FROM v_raw_bins b JOIN v_sites s ON b.site = s.site) h
        ON p.site = h.site AND p.ts = h.ts""",
)
def _(v: Views) -> DataFrame:
    return hydro.gauged_record(v.readings, v.sites, None)


@query("gauge_join", final("v_gauged", "site ts", "precip_mm head_mm"))
def _(v: Views) -> DataFrame:
    return v.gauged


@query("rating_flow", final("v_record", "site ts", "head_mm flow_lps"))
def _(v: Views) -> DataFrame:
    return v.record.select("site", "ts", "head_mm", "flow_lps")


@query(
    "record_maxima",
    final("(SELECT site, max(precip_mm) AS max_precip_mm, max(flow_lps) AS max_flow_lps, max(inflow_lps) AS max_inflow_lps FROM v_record GROUP BY 1)", "site", "max_precip_mm max_flow_lps max_inflow_lps"),
)
def _(v: Views) -> DataFrame:
    return hydro.record_maxima(v.record)


@query("storm_labels", final("v_labelled", "site ts storm_number", "precip_mm flow_lps"))
def _(v: Views) -> DataFrame:
    return v.labelled.select("site", "ts", "storm_number", "precip_mm", "flow_lps")


@query(
    "record_labels",
    """SELECT r.site, r.ts, CASE WHEN r.ts < t.end_date THEN t.storm_number ELSE 0 END AS storm_number
        FROM v_gauged r ASOF LEFT JOIN v_stats t ON r.site = t.site AND r.ts >= t.start_date""",
)
def _(v: Views) -> DataFrame:
    return storms.label_record(v.gauged, v.storm_stats).select("site", "ts", "storm_number")


_STORM_KEYS = "site storm_number year season grouped_season start_date end_date has_outflow"
_STORM_DOUBLES = " ".join(c for c in storms.STORM_COLUMNS if c not in _STORM_KEYS.split())


_RUNOFF = "CASE WHEN CAST(site AS INT) % 2 = 0 THEN pow(10, CAST(1.58 AS DOUBLE) + CAST(0.0169 AS DOUBLE) * total_precip_depth) ELSE greatest(0.0, CAST(12.05 AS DOUBLE) + CAST(2.873 AS DOUBLE) * total_precip_depth + CAST(0.863 AS DOUBLE) * duration_hours) END"


_REFRESHED = "duration_hours antecedent_days peak_precip_intensity total_precip_depth total_outflow_m3 peak_outflow"


@query("storms_refreshed", final("v_stats", "site storm_number start_date end_date", _REFRESHED))
def _(v: Views) -> DataFrame:
    """The storms of a stored record that gets its bins in three parts, in no order of time."""
    folder, record = lineage.shared_folder(v.spark), lineage.cut(v.record)
    for part in range(3):
        refresh.insert_bins(v.spark, folder, record.where(F.pmod(F.xxhash64("site", "ts"), F.lit(3)) == part), 6, GRID_MINUTES)
    storms_now = refresh.stored_storms(v.spark, folder)
    return storms_now.select("site", F.col("storm_number").cast("int"), "start_date", "end_date", *_REFRESHED.split())


_RUNOFF_NAMED = _RUNOFF.replace("CAST(site AS INT) % 2 = 0", "site IN ('2', '4')")


@query(
    "storm_volumes_by_site",
    final(f"(SELECT site, storm_number, {_RUNOFF_NAMED} AS runoff_m3 FROM v_stats)", "site storm_number", "runoff_m3"),
)
def _(v: Views) -> DataFrame:
    """Named sites with a regression of their own, every other site with the common one."""
    power, linear = volumes.power_volume(1.58, depth=0.0169), volumes.linear_volume(12.05, depth=2.873, duration=0.863)
    return v.storm_stats.select("site", "storm_number", volumes.by_site({"2": power, "4": power}, default=linear).alias("runoff_m3"))


@query("storm_volumes_all_sites", final(f"(SELECT site, storm_number, {_RUNOFF} AS runoff_m3 FROM v_stats)", "site storm_number", "runoff_m3"))
def _(v: Views) -> DataFrame:
    """The storms of every site, with the regression of the site's kind."""
    equations = {"0": volumes.power_volume(1.58, depth=0.0169), "1": volumes.linear_volume(12.05, depth=2.873, duration=0.863)}
    stats = v.storm_stats.withColumn("kind", (F.col("site").cast("int") % 2).cast("string"))
    return stats.select("site", "storm_number", volumes.by_site(equations, "kind").alias("runoff_m3"))


@query("storm_table", final("v_storm_table", _STORM_KEYS, _STORM_DOUBLES))
def _(v: Views) -> DataFrame:
    return v.storm_table


@query(
    "storm_lags",
    final("v_stats", "site storm_number peak_precip_time peak_outflow_time", "peak_lag_hours centroid_lag_hours total_outflow_m3"),
)
def _(v: Views) -> DataFrame:
    return v.storm_stats.select(
        "site", "storm_number", "peak_precip_time", "peak_outflow_time", "peak_lag_hours", "centroid_lag_hours", "total_outflow_m3"
    )


@query(
    "storm_edits",
    final(
        """(SELECT site, storm_number, min(ts) AS start_date, count(*) AS bins, sum(precip_mm) AS total_precip_depth FROM (
            SELECT l.site, l.ts, l.precip_mm, CASE WHEN ts BETWEEN mute_from AND mute_to THEN 0
                ELSE storm_number + CASE WHEN ts >= shift_from THEN 1 ELSE 0 END END AS storm_number
            FROM v_labelled l JOIN v_edits e ON l.site = e.site)
        GROUP BY ALL)""",
        "site storm_number start_date bins",
        "total_precip_depth",
    ),
    v_edits="""SELECT site, min(ts) + INTERVAL '2 days' AS mute_from, min(ts) + INTERVAL '4 days' AS mute_to,
        min(ts) + INTERVAL '6 days' AS shift_from FROM v_readings GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    edits = v.readings.groupBy("site").agg(F.min("ts").alias("t")).selectExpr(
        "site", "t + interval 2 days AS mute_from", "t + interval 4 days AS mute_to", "t + interval 6 days AS shift_from"
    )
    edited = storms.label_wet_bins(v.record, 6, GRID_MINUTES, edits)
    # every edited site has readings; sites known only by their gauge have no edits
    return (
        edited.join(edits.select("site"), "site", "left_semi")
        .groupBy("site", "storm_number")
        .agg(F.min("ts").alias("start_date"), F.count(F.lit(1)).alias("bins"), F.sum("precip_mm").alias("total_precip_depth"))
    )


@query(
    "storm_overrides",
    final(
        """(SELECT t.site, t.storm_number, t.start_date, CASE WHEN o.site IS NOT NULL THEN o.inflow_m3 ELSE t.inflow_m3 END AS inflow_m3,
            CASE WHEN o.site IS NOT NULL THEN o.outflow_m3 ELSE t.outflow_m3 END AS outflow_m3,
            CASE WHEN o.site IS NOT NULL THEN NULL ELSE t.runoff_m3 END AS runoff_m3
        FROM v_storm_table t LEFT JOIN v_overrides o ON t.site = o.site AND CAST(t.start_date AS DATE) = o.start_day)""",
        "site storm_number start_date",
        "inflow_m3 outflow_m3 runoff_m3",
    ),
    v_overrides="""SELECT site, CAST(min(ts) AS DATE) + 3 AS start_day, CAST(430.603 AS DOUBLE) AS inflow_m3,
        CAST(250.965 AS DOUBLE) AS outflow_m3 FROM v_readings GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    overrides = v.readings.groupBy("site").agg(F.min("ts").alias("t")).selectExpr(
        "site", "date_add(to_date(t), 3) AS start_day", "430.603D AS inflow_m3", "250.965D AS outflow_m3",
        "CAST(NULL AS DOUBLE) AS runoff_m3",
    )
    changed = storms.override_volumes(v.storm_table, overrides, ["inflow_m3", "outflow_m3", "runoff_m3"])
    return changed.select("site", "storm_number", "start_date", "inflow_m3", "outflow_m3", "runoff_m3")


@query(
    "simple_method",
    final(
        """(SELECT t.site, storm_number, total_precip_depth * (total_area * (0.05 + 0.9 * impervious_area / total_area) + bmp_area) / 1000 AS runoff_m3
        FROM v_stats t JOIN v_sites s ON t.site = s.site)""",
        "site storm_number",
        "runoff_m3",
    ),
)
def _(v: Views) -> DataFrame:
    runoff = volumes.simple_method("total_precip_depth", "total_area", "impervious_area", "bmp_area", 0.001)
    return v.storm_stats.join(v.sites, "site").select("site", "storm_number", runoff.alias("runoff_m3"))


# --- samples and storms -----------------------------------------------------------------


@query(
    "wq_results",
    final("v_lab", "site sample sampletype samplestart samplestop interval_minutes parameter units qualifier season grouped_season year", "detectionlimit concentration"),
)
def _(v: Views) -> DataFrame:
    return v.lab


@query("storm_sample_asof", "SELECT site, sample, sampletype, samplestart, storm_number FROM v_matched_samples")
def _(v: Views) -> DataFrame:
    return v.matched_samples.select("site", "sample", "sampletype", "samplestart", "storm_number")


@query(
    "sampled_storms",
    """SELECT site, storm_number, start_date FROM v_stats WHERE (site, storm_number) IN
        (SELECT (site, storm_number) FROM v_matched_samples WHERE sampletype = 'composite' AND storm_number IS NOT NULL)""",
)
def _(v: Views) -> DataFrame:
    return samples.storms_with_samples(v.storm_stats, v.matched_samples).select("site", "storm_number", "start_date")


@query(
    "unsampled_storms",
    """SELECT t.site, t.storm_number, t.start_date FROM v_stats t WHERE NOT EXISTS (SELECT 1 FROM v_matched_samples m
        WHERE m.sampletype = 'composite' AND m.site = t.site AND m.storm_number = t.storm_number)""",
)
def _(v: Views) -> DataFrame:
    return samples.storms_without_samples(v.storm_stats, v.matched_samples).select("site", "storm_number", "start_date")


@query(
    "storm_sample_dates",
    """SELECT site, storm_number, sampletype, samplestart AS sampledate FROM v_matched_samples
        WHERE sampletype IN ('grab', 'composite') AND storm_number IS NOT NULL""",
)
def _(v: Views) -> DataFrame:
    return samples.storm_sample_dates(v.matched_samples)


@query("sample_dates", "SELECT site, sample, samplestop AS sampledate FROM v_samples WHERE sampletype = 'composite'")
def _(v: Views) -> DataFrame:
    return samples.sample_dates(v.samples, "composite", "end")


@query(
    "bad_sample_types",
    "SELECT sample, site, sampletype FROM v_raw_samples WHERE lower(sampletype) NOT IN ('grab', 'composite')",
)
def _(v: Views) -> DataFrame:
    return samples.bad_sample_types(v.raw_samples).select("sample", "site", "sampletype")


@query("unknown_parameters", "SELECT parameter, count(*) AS rows FROM v_results WHERE parameter = 'Mystery' GROUP BY 1")
def _(v: Views) -> DataFrame:
    return samples.unknown_parameters(v.results)


@query(
    "unknown_sites",
    "SELECT DISTINCT CAST(o_custkey * 2 AS VARCHAR) AS site FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
)
def _(v: Views) -> DataFrame:
    return samples.unknown_sites(v.table("orders").selectExpr("CAST(o_custkey * 2 AS STRING) AS site"), v.sites.select("site"))


@query(
    "repeated_composites",
    """SELECT site, storm_number, count(DISTINCT sample) AS composites FROM v_matched_samples
        WHERE sampletype = 'composite' AND storm_number IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT sample) > 1""",
)
def _(v: Views) -> DataFrame:
    return samples.repeated_composites(v.matched_samples)


# --- tidy tables ----------------------------------------------------------------------------

_INFLUENT = """SELECT parameter, season, units, quantile_cont(concentration, 0.25) AS influent_lower,
    quantile_cont(concentration, 0.5) AS influent_median, quantile_cont(concentration, 0.75) AS influent_upper
    FROM v_wq WHERE sampletype = 'grab' AND parameter IS NOT NULL AND concentration IS NOT NULL GROUP BY ALL"""


def _influent(v: Views) -> DataFrame:
    probs = {"influent_lower": 0.25, "influent_median": 0.5, "influent_upper": 0.75}
    return quantiles(v.wq.filter("sampletype = 'grab'"), ["parameter", "season", "units"], "concentration", probs)


_FACTOR = "CASE units WHEN 'ug/L' THEN CAST(0.001 AS DOUBLE) WHEN 'mg/L' THEN 1.0 WHEN 'CFU/100 mL' THEN 10000.0 END"
_TIDY_LOADS_SQL = ", ".join(
    f"factor * {part}_m3 * influent_{b} AS load_{part}{s}"
    for part in ("runoff", "bypass", "inflow")
    for b, s in (("lower", "_lower"), ("median", ""), ("upper", "_upper"))
)
_TIDY_LOADS = [f"load_{p}{s}" for p in ("runoff", "bypass", "inflow") for s in ("_lower", "", "_upper")]


@query(
    "tidy_measured",
    final(
        f"""(SELECT *, factor * outflow_m3 * concentration AS load_outflow, {_TIDY_LOADS_SQL} FROM (
            SELECT t.*, w.sample, w.sampletype, w.samplestart, w.parameter, w.units, w.qualifier, w.concentration,
                i.influent_lower, i.influent_median, i.influent_upper, {_FACTOR.replace("units", "w.units")} AS factor,
                CASE WHEN w.parameter = 'Escherichia coli' THEN 'CFU' WHEN w.parameter IS NOT NULL THEN 'g' END AS load_units
            FROM v_storm_table t
            LEFT JOIN v_matched_lab w ON t.site = w.site AND t.storm_number = w.storm_number AND t.year = w.year
                AND t.season = w.season
            LEFT JOIN v_influent i ON w.parameter = i.parameter AND t.season = i.season AND w.units = i.units))""",
        "site storm_number sample sampletype samplestart parameter units qualifier load_units",
        f"concentration influent_median outflow_m3 load_outflow {' '.join(_TIDY_LOADS)}",
        4,
    ),
    digits=4,
    v_influent=_INFLUENT,
)
def _(v: Views) -> DataFrame:
    return quality.tidy_measured(v.matched_lab, v.kept_storms, _influent(v)).select(
        "site", "storm_number", "sample", "sampletype", "samplestart", "parameter", "units", "qualifier", "load_units",
        "concentration", "influent_median", "outflow_m3", "load_outflow", *_TIDY_LOADS,
    )


_EFFLUENT_SQL = """SELECT {by}, CASE WHEN enough THEN lower ELSE p05 END AS effluent_lower, median AS effluent_median,
    CASE WHEN enough THEN upper ELSE p95 END AS effluent_upper
    FROM (SELECT o.*, q.p05, q.p95, coalesce(c.k > 10, false) AS enough FROM ({order}) o
        JOIN (SELECT {by}, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.95) AS p95 FROM ros GROUP BY ALL) q
            USING ({by})
        LEFT JOIN (SELECT site, count(*) AS k FROM v_samples WHERE sampletype = 'composite' GROUP BY 1) c ON o.site = c.site)"""


def _effluent_sql(by: str) -> str:
    return _EFFLUENT_SQL.format(by=", ".join(by.split()), order=oracle.order_bounds("ros", by, "r"))


_LAB_COMPOSITES = "(SELECT * FROM v_lab WHERE sampletype = 'composite')"
_LAB_ROS = oracle.ros(_LAB_COMPOSITES, "site parameter units season", "concentration", "qualifier = '<'")


def _effluent(v: Views) -> DataFrame:
    return quality.site_effluent(v.lab, v.samples, groupby_col="season")


@query(
    "effluent",
    final("v_effluent", "site parameter units season", "effluent_lower effluent_median effluent_upper"),
    **_LAB_ROS,
    v_effluent=_effluent_sql("site parameter units season"),
)
def _(v: Views) -> DataFrame:
    return _effluent(v)


# Influent per site: even sites use the medians of the grabs, odd ones those of the composites.
_SOURCED = """SELECT sampletype AS source, parameter, season, units, quantile_cont(concentration, 0.25) AS influent_lower,
    quantile_cont(concentration, 0.5) AS influent_median, quantile_cont(concentration, 0.75) AS influent_upper
    FROM v_wq WHERE sampletype <> 'unsampled' AND parameter IS NOT NULL AND concentration IS NOT NULL GROUP BY ALL"""
_OWNED = """SELECT c.site, i.* EXCLUDE (source) FROM v_sourced i JOIN (SELECT site,
    CASE WHEN CAST(site AS BIGINT) % 2 = 0 THEN 'grab' ELSE 'composite' END AS source FROM v_sites) c ON i.source = c.source
    WHERE c.site IN (SELECT site FROM v_storm_table)"""
_TIDY_WQ = f"""SELECT *, {_TIDY_LOADS_SQL},
        factor * outflow_m3 * coalesce(concentration, effluent_lower) AS load_outflow_lower,
        factor * outflow_m3 * coalesce(concentration, effluent_median) AS load_outflow,
        factor * outflow_m3 * coalesce(concentration, effluent_upper) AS load_outflow_upper
    FROM (SELECT *, {_FACTOR} AS factor, CASE WHEN parameter = 'Escherichia coli' THEN 'CFU'
            WHEN parameter <> 'Mystery' THEN 'g' END AS load_units
        FROM (SELECT coalesce(b.site, w.site) AS site, coalesce(b.storm_number, w.storm_number) AS storm_number,
                coalesce(b.year, w.year) AS year, coalesce(b.season, w.season) AS season,
                coalesce(b.parameter, w.parameter) AS parameter, coalesce(b.units, w.units) AS units,
                b.* EXCLUDE (site, storm_number, year, season, grouped_season, parameter, units, owner),
                w.sample, coalesce(w.sampletype, 'unsampled') AS sampletype, w.samplestart, w.qualifier, w.concentration
            FROM (SELECT coalesce(x.owner, e.site) AS owner, coalesce(x.parameter, e.parameter) AS parameter,
                    coalesce(x.season, e.season) AS season, coalesce(x.units, e.units) AS units,
                    x.* EXCLUDE (owner, parameter, season, units), effluent_lower, effluent_median, effluent_upper
                FROM (SELECT coalesce(t.owner, i.site) AS owner, coalesce(t.parameter, i.parameter) AS parameter,
                        coalesce(t.season, i.season) AS season, coalesce(t.units, i.units) AS units,
                        t.* EXCLUDE (owner, parameter, season, units), influent_lower, influent_median, influent_upper
                    FROM (SELECT s.*, s.site AS owner, p.parameter, p.units FROM v_storm_table s
                        JOIN (SELECT DISTINCT site, parameter, units FROM v_lab) p ON s.site = p.site) t
                    FULL JOIN v_owned i ON t.owner = i.site AND t.parameter = i.parameter AND t.season = i.season
                        AND t.units = i.units) x
                FULL JOIN v_effluent e ON x.owner = e.site AND x.parameter = e.parameter AND x.season = e.season
                    AND x.units = e.units) b
            FULL JOIN (SELECT * FROM v_matched_lab WHERE sampletype = 'composite') w ON b.site = w.site
                AND b.storm_number = w.storm_number AND b.year = w.year AND b.season = w.season
                AND b.parameter = w.parameter AND b.units = w.units))"""
_TIDY_KEYS = "site storm_number year season parameter units sample sampletype samplestart qualifier has_outflow load_units"
_TIDY_DOUBLES = " ".join(
    ["concentration", "influent_lower", "influent_median", "influent_upper", "effluent_lower", "effluent_median",
     "effluent_upper", *_TIDY_LOADS, "load_outflow_lower", "load_outflow", "load_outflow_upper"]
)
_TIDY_SUBQUERIES = dict(
    v_sourced=_SOURCED, v_owned=_OWNED, **_LAB_ROS, v_effluent=_effluent_sql("site parameter units season"), v_tidy_wq=_TIDY_WQ
)


def _tidy_wq(v: Views) -> DataFrame:
    probs = {"lower": 0.25, "median": 0.5, "upper": 0.75}
    medians = quantiles(
        v.wq.filter("sampletype <> 'unsampled'").withColumnRenamed("sampletype", "source"),
        ["source", "parameter", "season", "units"], "concentration", probs,
    )
    sources = v.sites.selectExpr(
        "site", "CASE WHEN CAST(site AS BIGINT) % 2 = 0 THEN 'grab' ELSE 'composite' END AS source"
    ).join(v.kept_storms.select("site").distinct(), "site", "left_semi")
    matched = samples.match_storms(v.kept_lab, v.kept_storms, lookback_hours=LOOKBACK_HOURS)
    effluent = quality.site_effluent(v.kept_lab, v.samples, groupby_col="season")
    return quality.tidy_loads(cut(matched), v.kept_storms, quality.assign_influent(medians, sources), effluent)


@query("tidy_loads", final("v_tidy_wq", _TIDY_KEYS, _TIDY_DOUBLES, 4), digits=4, **_TIDY_SUBQUERIES)
def _(v: Views) -> DataFrame:
    return _tidy_wq(v).select(*_TIDY_KEYS.split(), *_TIDY_DOUBLES.split())


_UNSAMPLED = "duration_hours total_precip_depth runoff_m3 bypass_m3 inflow_m3 outflow_m3 load_runoff load_bypass load_inflow load_outflow"


@query(
    "unsampled_estimates",
    final(
        f"""(SELECT site, season, has_outflow, parameter, load_units, {", ".join(f"sum({c}) AS {c}" for c in _UNSAMPLED.split())}
        FROM v_tidy_wq WHERE sampletype = 'unsampled' AND site IS NOT NULL AND has_outflow IS NOT NULL GROUP BY ALL)""",
        "site season has_outflow parameter load_units",
        _UNSAMPLED,
        3,
    ),
    digits=3,
    **_TIDY_SUBQUERIES,
)
def _(v: Views) -> DataFrame:
    return quality.unsampled_estimates(_tidy_wq(v))


@query(
    "influent_template",
    final(
        """(SELECT p.parameter, p.units, s.season, m.median AS influent_median
        FROM (VALUES """
        + ", ".join(f"('{p[0]}', '{p[1]}')" for p in _TEMPLATE)
        + """) p(parameter, units), (VALUES ('winter'), ('spring'), ('summer'), ('autumn')) s(season)
        LEFT JOIN """
        + _MEDIANS
        + " m ON p.parameter = m.parameter AND p.units = m.units AND s.season = m.season)",
        "parameter units season",
        "influent_median",
    ),
)
def _(v: Views) -> DataFrame:
    medians = summaries.plain_medians(v.wq.filter("sampletype = 'composite'"))
    return (
        pollutants.influent_template(v.spark).drop("influent_median")
        .join(medians, ["parameter", "units", "season"], "left")
        .withColumnRenamed("median", "influent_median")
    )


# --- censored statistics -----------------------------------------------------------------------

_WQ_COMPOSITES = "(SELECT * FROM v_wq WHERE sampletype = 'composite')"
_WQ_ROS = oracle.ros(_WQ_COMPOSITES, "site parameter units", "concentration", "qualifier = '<'")


def _composites(v: Views) -> DataFrame:
    return v.wq.filter("sampletype = 'composite'")


@query(
    "ros_values",
    "SELECT site, parameter, units, round(v, 6) AS concentration, censored, round(position, 9) AS position, "
    "round(r, 6) AS ros_concentration FROM ros",
    digits=9,
    **_WQ_ROS,
)
def _(v: Views) -> DataFrame:
    return censored.ros_values(_composites(v), ["site", "parameter", "units"]).withColumns(
        {"concentration": F.round("concentration", 6), "ros_concentration": F.round("ros_concentration", 6)}
    )


@query(
    "ros_percentiles",
    final(
        "(SELECT site, parameter, units, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.95) AS p95 FROM ros GROUP BY ALL)",
        "site parameter units",
        "p05 p50 p95",
    ),
    **_WQ_ROS,
)
def _(v: Views) -> DataFrame:
    return censored.ros_percentiles(_composites(v), ["site", "parameter", "units"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})


@query(
    "median_bounds",
    final(f"({oracle.order_bounds('ros', 'site parameter units', 'r')})", "site parameter units n", "lower median upper"),
    **_WQ_ROS,
)
def _(v: Views) -> DataFrame:
    return censored.median_bounds(_composites(v), ["site", "parameter", "units"])


@query(
    "median_notches",
    final(
        """(SELECT site, parameter, units, count(*) AS n, quantile_cont(r, 0.5) AS median,
            quantile_cont(r, 0.5) - 1.57 * (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) / sqrt(count(*)) AS lower,
            quantile_cont(r, 0.5) + 1.57 * (quantile_cont(r, 0.75) - quantile_cont(r, 0.25)) / sqrt(count(*)) AS upper
        FROM ros GROUP BY ALL)""",
        "site parameter units n",
        "lower median upper",
    ),
    **_WQ_ROS,
)
def _(v: Views) -> DataFrame:
    return censored.median_bounds(_composites(v), ["site", "parameter", "units"], bounds="notch")


_BOOT_BY = "site parameter season"
_BOOT_ROS = oracle.ros(_WQ_COMPOSITES, _BOOT_BY, "concentration", "qualifier = '<'")
_BOOT_KEYS = ", ".join(_BOOT_BY.split())


@query(
    "median_bounds_bootstrap",
    final("v_boot", f"{_BOOT_BY} n", "lower median upper"),
    **_BOOT_ROS,
    boot_ranked=f"""SELECT {_BOOT_KEYS}, r, row_number() OVER (PARTITION BY {_BOOT_KEYS} ORDER BY r) AS k,
        count(*) OVER (PARTITION BY {_BOOT_KEYS}) AS n FROM ros""",
    boot_sizes="SELECT DISTINCT n, (n + 1) // 2 AS low_r, n // 2 + 1 AS high_r FROM boot_ranked",
    boot_chances="""SELECT n, k, sum(chance) FILTER (j >= low_r) AS low, sum(chance) FILTER (j >= high_r) AS high
        FROM (SELECT n, low_r, high_r, k, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n)
                + CASE WHEN k = n THEN CASE WHEN j = n THEN 0 ELSE -1e9 END ELSE (n - j) * ln(1 - k / n) END) AS chance
            FROM (SELECT *, unnest(range(low_r, n + 1)) AS j FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM boot_sizes)))
        GROUP BY n, k""",
    boot_ranks="SELECT n, min(k) FILTER (low >= 0.025) AS low_k, min(k) FILTER (high >= 0.975) AS high_k FROM boot_chances GROUP BY n",
    v_boot=f"""SELECT {_BOOT_KEYS}, n, max(r) FILTER (k = low_k) AS lower, quantile_cont(r, 0.5) AS median,
        max(r) FILTER (k = high_k) AS upper FROM boot_ranked JOIN boot_ranks USING (n) GROUP BY {_BOOT_KEYS}, n""",
)
def _(v: Views) -> DataFrame:
    return censored.bootstrap_median_bounds(_composites(v), _BOOT_BY.split())


_BCA_POINTS = f"""SELECT {_BOOT_KEYS}, n, median, lt, le, n // 2 AS c, low_x, high_x, before_x, after_x FROM (
        SELECT {_BOOT_KEYS}, n, quantile_cont(r, 0.5) AS median, max(r) FILTER (k = (n + 1) // 2) AS low_x, max(r) FILTER (k = n // 2 + 1) AS high_x,
            max(r) FILTER (k = greatest((n + 1) // 2 - 1, 1)) AS before_x, max(r) FILTER (k = least(n // 2 + 2, n)) AS after_x
        FROM boot_ranked GROUP BY ALL)
    JOIN (SELECT {_BOOT_KEYS}, count(*) FILTER (r < m) AS lt, count(*) FILTER (r <= m) AS le
        FROM (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY {_BOOT_KEYS}) AS m FROM boot_ranked) GROUP BY ALL) USING ({_BOOT_KEYS})"""
_Z = "1.959963984540054"


def _cdf(z: str) -> str:
    """Normal distribution at ``z``, by the series of odd powers over odd double factorials."""
    term = f"exp((2 * i + 1) * ln(abs({z})) - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1)))"
    return f"""CASE WHEN {z} = 0 THEN 0.5 ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi())
        * list_sum(list_transform(range(0, 200), lambda i: {term})) END"""


@query(
    "median_bounds_bca",
    final("v_bca", f"{_BOOT_BY} n", "lower median upper acceleration"),
    **_BOOT_ROS,
    boot_ranked=f"""SELECT {_BOOT_KEYS}, r, row_number() OVER (PARTITION BY {_BOOT_KEYS} ORDER BY r) AS k,
        count(*) OVER (PARTITION BY {_BOOT_KEYS}) AS n FROM ros""",
    boot_sizes="SELECT DISTINCT n, (n + 1) // 2 AS low_r, n // 2 + 1 AS high_r FROM boot_ranked",
    boot_chances="""SELECT n, k, sum(chance) FILTER (j >= low_r) AS low, sum(chance) FILTER (j >= high_r) AS high
        FROM (SELECT n, low_r, high_r, k, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n)
                + CASE WHEN k = n THEN CASE WHEN j = n THEN 0 ELSE -1e9 END ELSE (n - j) * ln(1 - k / n) END) AS chance
            FROM (SELECT *, unnest(range(low_r, n + 1)) AS j FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM boot_sizes)))
        GROUP BY n, k""",
    bca_points=_BCA_POINTS,
    bca_shares=f"""SELECT p.*, (coalesce(b.low, 0) + coalesce(b.high, 0) + coalesce(u.low, 0) + coalesce(u.high, 0)) / 4 AS share
        FROM bca_points p LEFT JOIN boot_chances b ON b.n = p.n AND b.k = lt LEFT JOIN boot_chances u ON u.n = p.n AND u.k = le""",
    bca_biased=oracle.normal_quantile("share", "bca_shares"),
    bca_left=f"""SELECT {_BOOT_KEYS}, unnest(CASE WHEN n % 2 = 1 THEN [{{'m': (low_x + after_x) / 2, 'c': c}}, {{'m': (before_x + low_x) / 2, 'c': c}},
            {{'m': (before_x + after_x) / 2, 'c': 1}}] ELSE [{{'m': high_x, 'c': c}}, {{'m': low_x, 'c': c}}] END, recursive := true), median FROM bca_biased""",
    bca_moved=f"""SELECT {_BOOT_KEYS}, CASE WHEN sum(d * d * c) > pow(max(median) * 1e-9, 2) AND sum(c) > 2 THEN sum(d * d * d * c) / (6 * pow(sum(d * d * c), 1.5)) ELSE 0 END AS a
        FROM (SELECT *, sum(m * c) OVER (PARTITION BY {_BOOT_KEYS}) / sum(c) OVER (PARTITION BY {_BOOT_KEYS}) - m AS d FROM bca_left) GROUP BY ALL""",
    bca_points_z=f"""SELECT *, z + (z - {_Z}) / (1 - a * (z - {_Z})) AS z_low, z + (z + {_Z}) / (1 - a * (z + {_Z})) AS z_high
        FROM bca_biased JOIN bca_moved USING ({_BOOT_KEYS})""",
    bca_levels=f"SELECT *, {_cdf('z_low')} AS p_low, {_cdf('z_high')} AS p_high FROM bca_points_z",
    bca_ranks=f"""SELECT {_BOOT_KEYS}, min(k) FILTER (low >= p_low) AS low_k, min(k) FILTER (high >= p_high) AS high_k
        FROM bca_levels JOIN boot_chances USING (n) GROUP BY ALL""",
    v_bca=f"""SELECT {_BOOT_KEYS}, p.n, max(r) FILTER (k = low_k) AS lower, median, max(r) FILTER (k = high_k) AS upper, a AS acceleration
        FROM bca_levels p JOIN bca_ranks USING ({_BOOT_KEYS}) JOIN boot_ranked USING ({_BOOT_KEYS}) GROUP BY {_BOOT_KEYS}, p.n, median, a""",
)
def _(v: Views) -> DataFrame:
    return resampling.bca_median_bounds(_composites(v), _BOOT_BY.split())


_POISSON = " ".join(f"WHEN g < {limit} THEN {k}" for k, limit in enumerate(resampling.poisson_limits()))
_POISSON = f"CASE {_POISSON} ELSE {len(resampling.poisson_limits())} END"
_RESAMPLED = "primary_landuse, parameter, season"
_RESAMPLED_STATS = {"mean": "mean", "cov": "cov", "p90": 0.9}
_RESAMPLED_BOUNDS = ", ".join(
    f"quantile_cont({k}, {p}) AS {k}_{side}" for k in _RESAMPLED_STATS for side, p in (("lower", resampling.TAIL), ("upper", 1 - resampling.TAIL))
)


@query(
    "bootstrap_statistics",
    final(
        f"""(SELECT * FROM (SELECT {_RESAMPLED}, count(*) AS n, avg(v) AS mean, stddev_samp(v) / nullif(avg(v), 0) AS cov, quantile_cont(v, 0.9) AS p90
                FROM boot_rows GROUP BY ALL)
            JOIN (SELECT {_RESAMPLED}, {_RESAMPLED_BOUNDS} FROM boot_replicates GROUP BY ALL) USING ({_RESAMPLED}))""",
        f"{_RESAMPLED.replace(',', '')} n",
        " ".join(f"{k}{side}" for k in _RESAMPLED_STATS for side in ("", "_lower", "_upper")),
    ),
    boot_rows=f"""SELECT {_RESAMPLED}, res AS v, md5('{resampling.SEED}:' || {resampling.row_key(["row_id"]).format(text="VARCHAR")}) AS h
        FROM v_landuse_raw WHERE res IS NOT NULL AND parameter IS NOT NULL""",
    boot_draws=f"""SELECT {_RESAMPLED}, v, b, (('0x' || h[1:8])::BIGINT + b * ('0x' || h[9:16])::BIGINT) % {resampling.PRIME} AS g
        FROM boot_rows, range({resampling.REPLICATES}) t(b)""",
    boot_replicates=f"""SELECT {_RESAMPLED}, b, avg(v) AS mean, stddev_samp(v) / nullif(avg(v), 0) AS cov, quantile_cont(v, 0.9) AS p90
        FROM (SELECT *, unnest(range({_POISSON})) FROM boot_draws) GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    return resampling.bootstrap_bounds(v.landuse_raw, _RESAMPLED.split(", "), "res", _RESAMPLED_STATS, ["row_id"])


_SITE_SEASON_ROS = oracle.ros(_WQ_COMPOSITES, "site parameter units season", "concentration", "qualifier = '<'")
_SITE_LOAD_ROS = oracle.ros(_WQ_COMPOSITES, "site parameter load_units year", "load_outflow", "qualifier = '<'")


def _site_medians_sql(by: str) -> str:
    return final(
        f"""(SELECT * EXCLUDE (lower, median, upper, n), lower AS effluent_lower, median AS effluent_median,
            upper AS effluent_upper FROM ({oracle.order_bounds("ros", by, "r")}))""",
        by,
        "effluent_lower effluent_median effluent_upper",
    )


@query("site_medians_by_season", _site_medians_sql("site parameter units season"), **_SITE_SEASON_ROS)
def _(v: Views) -> DataFrame:
    return quality.site_medians(v.wq, groupby_col="season")


@query("site_medians_loads_by_year", _site_medians_sql("site parameter load_units year"), **_SITE_LOAD_ROS)
def _(v: Views) -> DataFrame:
    return quality.site_medians(v.wq, "load_outflow", groupby_col="year")


# --- external data --------------------------------------------------------------------------------

_RENAME_LANDUSE = "CASE parameter " + " ".join(f"WHEN '{p[2]}' THEN '{p[0]}'" for p in PARAMETERS.values()) + " END"
_RENAME_FACILITY = "CASE parameter " + " ".join(f"WHEN '{p[1]}' THEN '{p[0]}'" for p in PARAMETERS.values()) + " END"
_LANDUSE_ROWS = f"""SELECT * REPLACE ({_RENAME_LANDUSE} AS parameter) FROM v_landuse_raw
    WHERE primary_landuse <> 'Unknown' AND fraction = 'Total' AND epa_rain_zone = 1 AND parameter <> 'Mystery'"""
_KEY = ", ".join(external.LANDUSE_KEY)
_LANDUSE_DATA = f"""SELECT * REPLACE (CASE WHEN units = 'MPN/100 mL' THEN 'CFU/100 mL' ELSE units END AS units)
    FROM (SELECT {_KEY}, min(row_id) AS row_id, arg_min(res, row_id) FILTER (res IS NOT NULL) AS res,
            arg_min(qual, row_id) FILTER (qual IS NOT NULL) AS qual, 'Total' AS fraction
        FROM v_landuse_rows GROUP BY ALL)"""
_LANDUSE = dict(v_landuse_rows=_LANDUSE_ROWS, v_landuse_data=_LANDUSE_DATA)


def _landuse(v: Views) -> DataFrame:
    return external.landuse_data(v.landuse_raw, ["row_id"])


@query(
    "landuse_scan",
    final("v_landuse_rows", "row_id epa_rain_zone location_code station_name primary_landuse start_date station parameter units season qual", "res"),
    **_LANDUSE,
)
def _(v: Views) -> DataFrame:
    return external.landuse_rows(v.landuse_raw).select(
        "row_id", "epa_rain_zone", "location_code", "station_name", "primary_landuse", "start_date", "station",
        "parameter", "units", "season", "qual", "res",
    )


@query("landuse_dedupe", final("v_landuse_data", " ".join([*external.LANDUSE_KEY, "row_id", "qual"]), "res"), **_LANDUSE)
def _(v: Views) -> DataFrame:
    return _landuse(v).select(*external.LANDUSE_KEY, "row_id", "qual", "res")


def _even(c: str, digits: int = 3) -> str:
    return f"round_even({c}, {digits}) AS {c}"


def _landuse_medians_sql(by: str) -> tuple[str, dict[str, str]]:
    keys = ", ".join(by.split())
    parts = {
        **_LANDUSE,
        **oracle.ros("(SELECT * FROM v_landuse_data WHERE primary_landuse = 'Residential')", by, "res", "qual = '<'"),
    }
    return f"SELECT {keys}, {_even('lower')}, {_even('median')}, {_even('upper')} FROM ({oracle.order_bounds('ros', by, 'r')})", parts


_LM_SQL, _LM_PARTS = _landuse_medians_sql("parameter units")
_LMS_SQL, _LMS_PARTS = _landuse_medians_sql("parameter units season")


@query("landuse_medians", _LM_SQL, **_LM_PARTS)
def _(v: Views) -> DataFrame:
    return external.landuse_medians(_landuse(v))


@query("landuse_medians_by_season", _LMS_SQL, **_LMS_PARTS)
def _(v: Views) -> DataFrame:
    return external.landuse_medians(_landuse(v), seasonal=True)


@query(
    "landuse_plain_medians",
    final(
        """(SELECT parameter, units, season, quantile_cont(res, 0.5) AS median FROM v_landuse_data
        WHERE res IS NOT NULL GROUP BY ALL)""",
        "parameter units season",
        "median",
    ),
    **_LANDUSE,
)
def _(v: Views) -> DataFrame:
    return summaries.plain_medians(_landuse(v), "res", ["parameter", "units", "season"])


_FACILITY = f"""SELECT * REPLACE ({_RENAME_FACILITY} AS parameter) FROM v_facility_raw
    WHERE category <> 'Other' AND station = 'outflow' AND epazone = 1 AND parameter <> 'Mystery'"""
_FM_PARTS = {
    "v_facility": _FACILITY, **oracle.ros("v_facility", "parameter units category", "res", "qual = 'ND'"),
}
_FM_SQL = f"SELECT parameter, units, category, {_even('lower')}, {_even('median')}, {_even('upper')} FROM ({oracle.order_bounds('ros', 'parameter units category', 'r')})"


@query("facility_scan", final("v_facility", "category station epazone parameter units qual", "res"), v_facility=_FACILITY)
def _(v: Views) -> DataFrame:
    return external.facility_data(v.facility_raw)


@query("facility_medians", _FM_SQL, **_FM_PARTS)
def _(v: Views) -> DataFrame:
    return external.facility_medians(external.facility_data(v.facility_raw))


@query(
    "standards_with_medians",
    f"""SELECT s.parameter, s.units, round(lower_limit, 6) AS lower_limit, round(upper_limit, 6) AS upper_limit,
        m.lower AS landuse_lower, m.median AS landuse_median, m.upper AS landuse_upper
    FROM v_standards s JOIN ({_LM_SQL}) m ON s.parameter = m.parameter AND s.units = m.units""",
    **_LM_PARTS,
)
def _(v: Views) -> DataFrame:
    return external.standards_with_medians(v.standards, landuse=external.landuse_medians(_landuse(v)))


@query(
    "standards_with_facility_medians",
    f"""SELECT s.parameter, s.units, round(lower_limit, 6) AS lower_limit, round(upper_limit, 6) AS upper_limit, m.category,
        m.lower AS facility_lower, m.median AS facility_median, m.upper AS facility_upper
    FROM v_standards s JOIN ({_FM_SQL}) m ON s.parameter = m.parameter AND s.units = m.units""",
    **_FM_PARTS,
)
def _(v: Views) -> DataFrame:
    medians = external.facility_medians(external.facility_data(v.facility_raw))
    return external.standards_with_medians(v.standards, facility=medians)


_COMBINED_PARTS = dict(
    **_FM_PARTS,
    v_combined="""SELECT parameter, units, site, concentration FROM v_wq UNION ALL
        SELECT parameter, units, category AS site, r AS concentration FROM ros""",
)


def _combined(v: Views) -> DataFrame:
    estimates = external.external_estimates(external.facility_data(v.facility_raw), "category", ("ND",))
    return external.combine_wq(v.wq, estimates)


@query("combine_external", final("v_combined", "parameter units site", "concentration"), **_COMBINED_PARTS)
def _(v: Views) -> DataFrame:
    return _combined(v)


# --- plot tables -----------------------------------------------------------------------------------


def _box_sql(source: str, by: str) -> str:
    keys = ", ".join(by.split())
    return final(
        f"""(SELECT {keys}, count(*) AS count, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
            min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_low,
            max(CASE WHEN x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high,
            count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM (SELECT {keys}, concentration AS x FROM {source}
            WHERE concentration IS NOT NULL AND parameter IN {_IN_METALS}) p
        JOIN (SELECT {keys}, quantile_cont(concentration, 0.25) AS q1, quantile_cont(concentration, 0.5) AS median,
                quantile_cont(concentration, 0.75) AS q3 FROM {source} GROUP BY ALL) q USING ({keys})
        GROUP BY ALL)""",
        f"{by} count outliers",
        "q1 median q3 whisker_low whisker_high",
    )


@query("box_external", _box_sql("v_combined", "parameter site"), **_COMBINED_PARTS)
def _(v: Views) -> DataFrame:
    return charts.box_stats(_combined(v), params=METALS)


@query("box_seasonal", _box_sql("v_wq", "parameter site season"))
def _(v: Views) -> DataFrame:
    return charts.box_stats(v.wq, ["parameter", "site", "season"], params=METALS)


@query(
    "ts_points",
    final(
        f"""(SELECT parameter, site, samplestart, concentration FROM v_wq WHERE site IN ('S0', 'S2')
        AND parameter IN {_IN_METALS} AND concentration IS NOT NULL)""",
        "parameter site samplestart",
        "concentration",
    ),
)
def _(v: Views) -> DataFrame:
    return charts.ts_points(v.wq, "samplestart", "concentration", ["S0", "S2"], METALS)


_THIN_COLUMNS = 40
_PIXELS = f"""SELECT site, ts, level_mm, (x - lo) * {_THIN_COLUMNS} // (hi - lo + 1) AS pixel, x
    FROM (SELECT *, min(x) OVER (PARTITION BY site) AS lo, max(x) OVER (PARTITION BY site) AS hi
        FROM (SELECT site, ts, level_mm, epoch_us(ts) AS x FROM v_readings WHERE level_mm IS NOT NULL))"""


@query(
    "level_points_thinned",
    final(
        f"""(SELECT DISTINCT site, unnest([arg_min({{'ts': ts, 'level_mm': level_mm}}, (x, level_mm)), arg_max({{'ts': ts, 'level_mm': level_mm}}, (x, level_mm)),
                arg_min({{'ts': ts, 'level_mm': level_mm}}, (level_mm, x)), arg_max({{'ts': ts, 'level_mm': level_mm}}, (level_mm, x))], recursive := true)
            FROM pixels GROUP BY site, pixel)""",
        "site ts", "level_mm",
    ),
    pixels=_PIXELS,
)
def _(v: Views) -> DataFrame:
    """The levels of every site, thinned to a chart of a few columns."""
    return curves.thinned_points(v.readings, ["site"], "ts", "level_mm", _THIN_COLUMNS)


def _density_sql(steps: dict[str, float]) -> str:
    """The direct sum over all cells at every cell in reach of one."""
    names = list(steps)
    cells = ", ".join(f"CAST(floor({q} / {s}) AS BIGINT) AS i_{q}" for q, s in steps.items())
    widths = ", ".join(f"coalesce(nullif(stddev_samp({q}) * pow(count(*), {-1 / (len(steps) + 4)!r}), 0), {s}) AS h_{q}" for q, s in steps.items())
    reach = ", ".join(f"i_{q} + o_{q}.o AS g_{q}" for q in names)
    offsets = " ".join(f", LATERAL (SELECT unnest(range(-CAST(ceil(h_{q} / {s} * {curves.REACH}) AS BIGINT), CAST(ceil(h_{q} / {s} * {curves.REACH}) AS BIGINT) + 1)) AS o) o_{q}" for q, s in steps.items())
    kernel = " * ".join(f"exp(-pow((g_{q} - i_{q}) * {s} / h_{q}, 2) / 2) / (h_{q} * sqrt(2 * pi()))" for q, s in steps.items())
    grid = ", ".join(f"g_{q}" for q in names)
    centres = ", ".join(f"CAST((g_{q} + 0.5) * {s} AS DOUBLE) AS {q}" for q, s in steps.items())
    known = " AND ".join(f"{q} IS NOT NULL" for q in names)
    return final(
        f"""(WITH rows AS (SELECT site, {", ".join(names)} FROM v_storms WHERE {known}),
            cells AS (SELECT site, {cells}, count(*) AS m FROM rows GROUP BY ALL),
            widths AS (SELECT site, count(*) AS n, {widths} FROM rows GROUP BY site),
            grid AS (SELECT DISTINCT site, {reach} FROM cells JOIN widths USING (site) {offsets})
            SELECT site, {centres}, sum(m * {kernel}) / n AS density FROM grid JOIN cells USING (site) JOIN widths USING (site)
            GROUP BY site, {grid}, n)""",
        f"site {' '.join(names)}", "density", 9,
    )


@query("depth_density", _density_sql({"total_precip_depth": 1.0}), digits=9)
def _(v: Views) -> DataFrame:
    return curves.density(v.storms, ["site"], {"total_precip_depth": 1.0})


@query("joint_density", _density_sql({"total_precip_depth": 5.0, "duration_hours": 12.0}), digits=9)
def _(v: Views) -> DataFrame:
    return curves.density(v.storms, ["site"], {"total_precip_depth": 5.0, "duration_hours": 12.0})


@query(
    "prob_positions",
    final(
        """(SELECT parameter, site, concentration, 100 * CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
            ELSE (i - 0.3175) / (n + 0.365) END AS probability
        FROM (SELECT parameter, site, concentration, row_number() OVER w AS i, count(*) OVER (PARTITION BY parameter, site) AS n
            FROM v_wq WHERE concentration IS NOT NULL AND parameter IS NOT NULL
            WINDOW w AS (PARTITION BY parameter, site ORDER BY concentration)))""",
        "parameter site",
        "concentration probability",
    ),
)
def _(v: Views) -> DataFrame:
    return charts.probability_positions(v.wq, "concentration")


_HIST = "CASE WHEN total_precip_depth <= 5 THEN 0 WHEN total_precip_depth <= 10 THEN 1 WHEN total_precip_depth <= 15 THEN 2 WHEN total_precip_depth <= 20 THEN 3 WHEN total_precip_depth <= 25 THEN 4 ELSE 5 END"


@query(
    "storm_histogram",
    f"""SELECT site, has_outflow, season, CAST(bin_idx AS INT) AS bin_idx, count(*) AS storms, any_value(CASE bin_idx WHEN 0 THEN '<5' WHEN 1 THEN '5 - 10'
        WHEN 2 THEN '10 - 15' WHEN 3 THEN '15 - 20' WHEN 4 THEN '20 - 25' ELSE '>25' END) AS bin
    FROM (SELECT *, {_HIST} AS bin_idx FROM v_storms WHERE total_precip_depth IS NOT NULL) GROUP BY 1, 2, 3, 4""",
)
def _(v: Views) -> DataFrame:
    return charts.storm_histogram(v.storms, facets=["site", "has_outflow", "season"])


@query(
    "joint_counts",
    """SELECT site, floor(total_precip_depth / 5) * 5 AS x_from, floor(outflow_mm / 2) * 2 AS y_from, count(*) AS storms
    FROM v_storms WHERE outflow_mm > 0 GROUP BY 1, 2, 3""",
)
def _(v: Views) -> DataFrame:
    return charts.joint_counts(v.storms, "total_precip_depth", "outflow_mm", 5, 2, "outflow_mm > 0")


_CONDITION = "outflow_mm == 0 or season in ['winter', 'spring'] and not 5 < total_precip_depth <= @deep and `has_outflow` != 'No'"


@query(
    "joint_counts_condition",
    """SELECT site, floor(total_precip_depth / 5) * 5 AS x_from, floor(duration_hours / 12) * 12 AS y_from, count(*) AS storms
    FROM v_storms WHERE outflow_mm = 0 OR (season IN ('winter', 'spring') AND NOT (total_precip_depth > 5 AND total_precip_depth <= 20)
        AND has_outflow <> 'No') GROUP BY 1, 2, 3""",
)
def _(v: Views) -> DataFrame:
    """A joint plot of the storms that a condition of a notebook picks."""
    picked = conditions.condition(_CONDITION, {"deep": 20})
    return charts.joint_counts(v.storms, "total_precip_depth", "duration_hours", 5, 12, picked)


@query(
    "pair_correlations",
    " UNION ALL ".join(
        f"SELECT site, season AS hue, '{a}' AS xcol, '{b}' AS ycol, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS points, "
        f"round(corr({a}, {b}), 6) + 0.0 AS r FROM v_storms GROUP BY ALL"
        for i, a in enumerate(charts.PAIR_QUANTITIES)
        for b in charts.PAIR_QUANTITIES[i + 1 :]
    ),
)
def _(v: Views) -> DataFrame:
    return charts.pair_correlations(v.storms)


_PAIR_STEPS = {"antecedent_days": 5, "duration_hours": 12, "peak_precip_intensity": 5, "total_precip_depth": 5, "outflow_mm": 2}


@query(
    "pair_bins",
    " UNION ALL ".join(
        f"SELECT site, '{by}' AS hue_name, {hue} AS hue, '{a}' AS xcol, '{b}' AS ycol, "
        f"floor({a} / {_PAIR_STEPS[a]}) * {_PAIR_STEPS[a]} AS x_from, floor({b} / {_PAIR_STEPS[b]}) * {_PAIR_STEPS[b]} AS y_from, "
        f"count(*) AS storms FROM v_storms WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"
        for by, hue in charts.PAIR_HUES.items()
        for i, a in enumerate(charts.PAIR_QUANTITIES)
        for b in charts.PAIR_QUANTITIES[i + 1 :]
    ),
)
def _(v: Views) -> DataFrame:
    return charts.pair_bins(v.storms, _PAIR_STEPS)


@query(
    "reduction_bars",
    final(
        f"""(SELECT parameter, site, season, load_red AS y, load_red - load_red_lower AS err_low, load_red_upper - load_red AS err_high,
            row_number() OVER (PARTITION BY parameter, site ORDER BY season) - 1 + CAST(CASE site WHEN 'S0' THEN 0.0 WHEN 'S1' THEN -0.2 WHEN 'S2' THEN 0.2 END AS DOUBLE) AS x
        FROM {_PCT_SEASON} WHERE parameter IN {_IN_METALS})""",
        "parameter site season",
        "y err_low err_high x",
    ),
)
def _(v: Views) -> DataFrame:
    red = summaries.load_reduction_pct(v.wq, "season")
    return charts.reduction_bars(red, METALS, "season", {"S0": 0.0, "S1": -0.2, "S2": 0.2})


# --- report tables -------------------------------------------------------------------------------------


@query(
    "sample_tables",
    f"""SELECT DISTINCT t.site, t.storm_number, t.sampletype, t.parameter, {oracle.with_units("g.upper_limit", "t.units")} AS wq_guideline,
        {oracle.with_units("detectionlimit", "t.units")} AS detection_limit,
        {oracle.with_units("concentration", "t.units")} AS effluent_emc,
        {oracle.with_units("load_outflow", "load_units")} AS effluent_load
    FROM v_wq t JOIN v_standards g ON t.parameter = g.parameter WHERE t.parameter <> 'Escherichia coli'""",
)
def _(v: Views) -> DataFrame:
    return reports.wq_tables(v.wq, v.standards, ("site", "storm_number", "sampletype"))


def _line(ord_: int, label: str, text: str) -> str:
    return f"SELECT site, storm_number, CAST({ord_} AS INT) AS ord, '{label}' AS label, {text} AS text FROM named"


def _num(c: str, digits: int, units: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-- {units}' ELSE format('{{:.{digits}f}}', round({c}, {digits})) || ' {units}' END"


@query(
    "storm_reports",
    " UNION ALL ".join(
        [
            _line(1, "Site", "coalesce(sitename, site)"),
            _line(2, "Event Date", "strftime(start_date, '%Y-%m-%d %H:%M')"),
            _line(3, "Antecedent Dry Period", _num("antecedent_days", 1, "days")),
            _line(4, "Event Duration", _num("duration_hours", 1, "hr")),
            _line(5, "Peak Effluent Flow", _num("peak_outflow", 1, "L/s")),
            _line(6, "Peak Precipitation Intensity", _num("peak_precip_intensity", 0, "mm/hr")),
            _line(7, "Lag Time", _num("peak_lag_hours", 1, "hr")),
            _line(8, "Estimated Total Influent Volume", _num("inflow_m3", 0, "m$^3$")),
            _line(9, "Total Effluent Volume", _num("outflow_m3", 0, "m$^3$")),
            _line(10, "Total Precipitation", _num("total_precip_depth", 1, "mm")),
        ]
    ),
    named="SELECT t.*, s.sitename FROM v_storm_table t JOIN v_sites s ON t.site = s.site",
)
def _(v: Views) -> DataFrame:
    return reports.hydro_tables(v.storm_table, v.sites)


@query(
    "report_worklist",
    """SELECT site, sample, storm_number, stem || '-1-General' AS general_table, stem || '-2-Hydro' AS hydro_table,
        stem || '-3-WQComposite' AS wq_table, stem || '-Composite' AS storm_figure,
        site || '-' || strftime(samplestart, '%Y%m%d-%H%M') || '-Composite-ISR-draft' AS document
    FROM (SELECT *, site || '-' || strftime(samplestart, '%Y-%m-%d-%H%M') AS stem FROM v_matched_samples
        WHERE sampletype = 'composite' AND storm_number IS NOT NULL)""",
)
def _(v: Views) -> DataFrame:
    return reports.report_worklist(v.matched_samples, "composite").select(
        "site", "sample", "storm_number", "general_table", "hydro_table", "wq_table", "storm_figure", "document"
    )


@query(
    "significant_figures",
    f"SELECT l_orderkey, l_linenumber, l_partkey, {oracle.sig_figs('x', 3, 4)} AS text FROM (SELECT *, l_extendedprice * l_quantity / 997.0 AS x FROM lineitem)",
)
def _(v: Views) -> DataFrame:
    line = v.table("lineitem").withColumn("x", F.expr("l_extendedprice * l_quantity / 997.0"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", sig_figs("x", 3, 4).alias("text"))
