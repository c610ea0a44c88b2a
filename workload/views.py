"""Monitoring tables derived from the given tables, as DataFrames and as SQL.

``Views`` builds them in Spark; ``CTES`` holds the same definitions for the
SQL side of the check, and ``with_views`` puts the needed ones in front of a
query. Divisors such as 997 keep derived numbers away from decimal ties.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions.clock import season, with_time_groups
from freshet.functions.volumes import linear_volume, net_volume, power_volume
from freshet.operators import hydro, samples, storms
from freshet.operators.lineage import cut
from freshet.operators.samples import wq_results

PARAMETERS = {
    "ECONOMY": ("Cadmium (Cd)", "Cadmium, Total", "Cadmium", "ug/L"),
    "LARGE": ("Copper (Cu)", "Copper, Total", "Copper", "ug/L"),
    "MEDIUM": ("Zinc (Zn)", "Zinc, Total", "Zinc", "ug/L"),
    "PROMO": ("Escherichia coli", "Escherichia coli", "E. Coli", "CFU/100 mL"),
    "SMALL": ("Total Phosphorus", "Phosphorus as P, Total", "Phosphorous as P", "mg/L"),
    "STANDARD": ("Total Suspended Solids", "Total suspended solids", "Total Suspended Solids", "mg/L"),
}
CATEGORIES = ("Bioretention", "Detention Basin", "Green Roof", "Wetland Channel", "Other")
GRID_MINUTES = 10
LOOKBACK_HOURS = 6


def _case(col: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {default} END"


def _names(i: int, **changes) -> dict:
    return {k: changes.get(k, v[i]) for k, v in PARAMETERS.items()}


# Text shared by both engines: plain CASE expressions of the mapping above.
PARAM = f"CASE WHEN p_size = 50 THEN 'Mystery' ELSE {_case('p_type', _names(0))} END"
UNITS = _case("p_type", _names(3))
LAB_UNITS = _case("p_type", _names(3, PROMO="CFU/100mL"))
FACILITY_PARAM = f"CASE WHEN p_size = 50 THEN 'Mystery' ELSE {_case('p_type', _names(1))} END"
LANDUSE_PARAM = f"CASE WHEN p_size = 50 THEN 'Mystery' ELSE {_case('p_type', _names(2))} END"
LANDUSE_UNITS = _case("p_type", _names(3, PROMO="MPN/100 mL"))
LOAD_UNITS = "CASE WHEN p_type = 'PROMO' THEN 'CFU' ELSE 'g' END"
TYPE = "CASE l_returnflag WHEN 'A' THEN 'composite' WHEN 'R' THEN 'grab' ELSE 'unsampled' END"
QUALIFIER = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_discount <= 0.02 THEN '<' ELSE '=' END"
CONCENTRATION = "CASE WHEN l_discount >= 0.1 THEN NULL ELSE l_extendedprice / 997.0 END"
LANDUSE = (
    "CASE WHEN l_linenumber <= 2 THEN 'Residential' WHEN l_linenumber <= 4 THEN 'Commercial' "
    "WHEN l_linenumber = 5 THEN 'Industrial' ELSE 'Unknown' END"
)
_CATEGORY_ARMS = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES))
CATEGORY = f"CASE CAST(substr(p_brand, 7) AS INT) % 5 {_CATEGORY_ARMS} END"

_W = "l_quantity * l_extendedprice"
LOADS = {
    f"load_{part}{suffix}": f"{_W} / 30011.0 * {share} * {bound}"
    for part, share in (("runoff", "1.1"), ("bypass", "l_tax"), ("inflow", "1.0"), ("outflow", "(1 - l_discount * 5)"))
    for suffix, bound in (("_lower", "0.8"), ("", "1.0"), ("_upper", "1.2"))
}
LOADS = {k: f"CASE WHEN l_tax = 0 THEN NULL ELSE {v} END" if "bypass" in k else v for k, v in LOADS.items()}


class Views:
    """The monitoring tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _lines(self) -> DataFrame:
        line, part, supplier = self.table("lineitem"), self.table("part"), self.table("supplier")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
            supplier, F.col("l_suppkey") == F.col("s_suppkey")
        )

    @cached_property
    def wq(self) -> DataFrame:
        """Tidy water-quality rows with loads, one per line item."""
        df = self._lines().selectExpr(
            "concat('S', s_nationkey % 4) AS site",
            f"{PARAM} AS parameter",
            f"{UNITS} AS units",
            f"{TYPE} AS sampletype",
            "CASE l_linestatus WHEN 'O' THEN 'Yes' ELSE 'No' END AS has_outflow",
            "l_orderkey AS storm_number",
            "l_shipdate AS samplestart",
            "l_shipdate AS start_date",
            f"{QUALIFIER} AS qualifier",
            f"{CONCENTRATION} AS concentration",
            "l_tax / 9.7 AS detectionlimit",
            "l_quantity * 0.6 AS total_precip_depth",
            f"{LOAD_UNITS} AS load_units",
            "l_tax AS load_factor",
            *[f"{v} AS {k}" for k, v in LOADS.items()],
        )
        return with_time_groups(df, "samplestart")

    @cached_property
    def storms(self) -> DataFrame:
        """Storm rows, one per order."""
        df = self.table("orders").selectExpr(
            "concat('S', o_custkey % 4) AS site",
            "CAST(o_orderkey AS INT) AS storm_number",
            "o_orderdate AS start_date",
            "CAST(o_custkey % 72 AS DOUBLE) + 0.5 AS duration_hours",
            "o_totalprice / 9973.0 AS total_precip_depth",
            "o_totalprice / 4999.0 + o_custkey % 7 AS peak_precip_intensity",
            "CASE WHEN o_orderstatus = 'P' THEN 0.0D ELSE o_totalprice / 29989.0 END AS outflow_mm",
            "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE (o_custkey % 97) / 3.7D END AS antecedent_days",
            "CASE WHEN o_orderstatus = 'P' THEN 'No' ELSE 'Yes' END AS has_outflow",
        )
        return with_time_groups(df, "start_date")

    @cached_property
    def sites(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "CAST(c_custkey AS STRING) AS site",
            "c_name AS sitename",
            "1000.0D + abs(c_acctbal) AS total_area",
            "0.4D * (1000.0D + abs(c_acctbal)) AS impervious_area",
            "c_nationkey * 10.0D AS bmp_area",
            "c_nationkey AS weir_height_mm",
            "CAST(c_custkey - c_custkey % 4 AS STRING) AS raingauge",
        )

    @cached_property
    def readings(self) -> DataFrame:
        return self.table("events").filter("event_type <> 'purchase'").selectExpr(
            "CAST(user_id AS STRING) AS site",
            "ts",
            "CASE WHEN event_type IN ('error', 'signup') THEN value / 0.43D END AS level_mm",
            "CASE WHEN event_type IN ('view', 'click') THEN value / 7.13D END AS precip_mm",
        )

    @cached_property
    def curve(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "CAST(c_custkey AS STRING) AS site", "c_nationkey", "explode(sequence(0, 20)) AS k"
        ).selectExpr(
            "site", "k * 25.0D AS head_mm", "pow(k * 25.0D, 1.5D) / 100.0D * (1 + c_nationkey / 100.0D) AS flow_lps"
        )

    @cached_property
    def bins(self) -> DataFrame:
        return hydro.resample(hydro.head_above_weir(self.readings, self.sites), GRID_MINUTES)

    @cached_property
    def gauged(self) -> DataFrame:
        return hydro.join_gauge(self.bins, self.bins, self.sites)

    @cached_property
    def record(self) -> DataFrame:
        binned = hydro.gauged_record(self.readings, self.sites, GRID_MINUTES)
        rated = hydro.rate_flow(binned, self.curve)
        return rated.withColumn("inflow_lps", F.lit(None).cast("double"))

    @cached_property
    def labelled(self) -> DataFrame:
        return storms.label_wet_bins(self.record, 6, GRID_MINUTES)

    @cached_property
    def storm_stats(self) -> DataFrame:
        return storms.storm_stats(self.labelled, GRID_MINUTES)

    @cached_property
    def storm_table(self) -> DataFrame:
        return storms.storm_table(
            self.storm_stats,
            self.sites,
            runoff=power_volume(1.58, 0.000667, 0.0169),
            bypass=linear_volume(-26.4, 0.184, 1.22),
            inflow=net_volume("runoff_m3", "bypass_m3"),
            period_minutes=GRID_MINUTES,
        )

    @cached_property
    def kept_storms(self) -> DataFrame:
        """The storm table, computed once for the queries that read it often."""
        return cut(self.storm_table)

    @cached_property
    def raw_samples(self) -> DataFrame:
        return self.table("events").filter("event_type = 'purchase'").selectExpr(
            "CAST(event_id AS STRING) AS sample",
            "CAST(user_id AS STRING) AS site",
            "ts AS samplestart",
            "ts + interval 4 hours AS samplestop",
            "10 AS interval_minutes",
            "CASE WHEN event_id % 41 = 0 THEN 'Blank' WHEN event_id % 3 = 0 THEN 'Grab' ELSE 'Composite' END AS sampletype",
            "CASE WHEN event_id % 10 = 0 THEN 'QA' ELSE 'REGULAR' END AS labtype",
            "event_id % 17 = 0 AS ignore",
        )

    @cached_property
    def samples(self) -> DataFrame:
        return samples.regular_samples(self.raw_samples)

    @cached_property
    def results(self) -> DataFrame:
        line, part = self.table("lineitem"), self.table("part")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            "CAST(l_orderkey AS STRING) AS sample",
            f"{PARAM} AS parameter",
            f"{LAB_UNITS} AS units",
            "l_tax / 9.7 AS detectionlimit",
            f"{QUALIFIER} AS qualifier",
            f"{CONCENTRATION} AS concentration",
        )

    @cached_property
    def lab(self) -> DataFrame:
        return wq_results(self.results, self.raw_samples)

    @cached_property
    def kept_lab(self) -> DataFrame:
        """The lab results, computed once for the queries that read them often."""
        return cut(self.lab)

    @cached_property
    def matched_samples(self) -> DataFrame:
        return samples.match_storms(self.samples, self.storm_stats, lookback_hours=LOOKBACK_HOURS)

    @cached_property
    def matched_lab(self) -> DataFrame:
        return samples.match_storms(self.lab, self.kept_storms, lookback_hours=LOOKBACK_HOURS)

    @cached_property
    def standards(self) -> DataFrame:
        return (
            self.table("part").filter("p_size <> 50")
            .selectExpr(f"{PARAM} AS parameter", f"{UNITS} AS units", "p_retailprice / 99.7 AS limit")
            .groupBy("parameter", "units")
            .agg(F.min("limit").alias("lower_limit"), F.max("limit").alias("upper_limit"))
        )

    @cached_property
    def landuse_raw(self) -> DataFrame:
        df = self._lines().selectExpr(
            "l_orderkey * 10 + l_linenumber AS row_id",
            "s_nationkey % 3 AS epa_rain_zone",
            "l_suppkey % 3 AS location_code",
            "concat('St', l_partkey % 3) AS station_name",
            f"{LANDUSE} AS primary_landuse",
            "trunc(to_date(l_shipdate), 'month') AS start_date",
            "'outflow' AS station",
            f"{LANDUSE_PARAM} AS parameter",
            "CASE WHEN l_returnflag = 'N' THEN 'Dissolved' ELSE 'Total' END AS fraction",
            f"{LANDUSE_UNITS} AS units",
            f"{CONCENTRATION} AS res",
            f"{QUALIFIER} AS qual",
        )
        return df.withColumn("season", season("start_date"))

    @cached_property
    def facility_raw(self) -> DataFrame:
        return self._lines().selectExpr(
            f"{CATEGORY} AS category",
            "CASE l_linestatus WHEN 'O' THEN 'outflow' ELSE 'inflow' END AS station",
            "s_nationkey % 2 AS epazone",
            f"{FACILITY_PARAM} AS parameter",
            f"{UNITS} AS units",
            f"{CONCENTRATION} AS res",
            "CASE WHEN l_discount <= 0.02 THEN 'ND' ELSE '=' END AS qual",
        )


def season_sql(ts: str) -> str:
    md = f"(month({ts}) * 100 + day({ts}))"
    return (
        f"CASE WHEN {md} >= 1222 OR {md} < 322 THEN 'winter' WHEN {md} < 622 THEN 'spring' "
        f"WHEN {md} < 922 THEN 'summer' ELSE 'autumn' END"
    )


def groups_sql(ts: str) -> str:
    s = season_sql(ts)
    return (
        f"{s} AS season, CASE WHEN ({s}) IN ('winter', 'spring') THEN 'winter/spring' ELSE 'summer/autumn' END "
        f"AS grouped_season, CAST(year({ts}) AS VARCHAR) AS year"
    )


def _epoch(ts: str) -> str:
    return f"epoch_us({ts})"


_LINES = "lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"

CTES = {
    "v_wq": f"""
        SELECT 'S' || (s_nationkey % 4) AS site, {PARAM} AS parameter, {UNITS} AS units, {TYPE} AS sampletype,
            CASE l_linestatus WHEN 'O' THEN 'Yes' ELSE 'No' END AS has_outflow, l_orderkey AS storm_number,
            l_shipdate AS samplestart, l_shipdate AS start_date, {QUALIFIER} AS qualifier,
            {CONCENTRATION} AS concentration, l_tax / 9.7 AS detectionlimit,
            l_quantity * 0.6 AS total_precip_depth, {LOAD_UNITS} AS load_units, l_tax AS load_factor,
            {", ".join(f"{v} AS {k}" for k, v in LOADS.items())}, {groups_sql("l_shipdate")}
        FROM {_LINES}""",
    "v_storms": f"""
        SELECT 'S' || (o_custkey % 4) AS site, CAST(o_orderkey AS INT) AS storm_number, o_orderdate AS start_date,
            CAST(o_custkey % 72 AS DOUBLE) + 0.5 AS duration_hours, o_totalprice / 9973.0 AS total_precip_depth,
            o_totalprice / 4999.0 + o_custkey % 7 AS peak_precip_intensity,
            CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice / 29989.0 END AS outflow_mm,
            CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE (o_custkey % 97) / CAST(3.7 AS DOUBLE) END AS antecedent_days,
            CASE WHEN o_orderstatus = 'P' THEN 'No' ELSE 'Yes' END AS has_outflow, {groups_sql("o_orderdate")}
        FROM orders""",
    "v_sites": """
        SELECT CAST(c_custkey AS VARCHAR) AS site, c_name AS sitename, 1000.0 + abs(c_acctbal) AS total_area,
            CAST(0.4 AS DOUBLE) * (1000.0 + abs(c_acctbal)) AS impervious_area,
            c_nationkey * CAST(10 AS DOUBLE) AS bmp_area, c_nationkey AS weir_height_mm,
            CAST(c_custkey - c_custkey % 4 AS VARCHAR) AS raingauge
        FROM customer""",
    "v_readings": """
        SELECT CAST(user_id AS VARCHAR) AS site, ts,
            CASE WHEN event_type IN ('error', 'signup') THEN value / CAST(0.43 AS DOUBLE) END AS level_mm,
            CASE WHEN event_type IN ('view', 'click') THEN value / CAST(7.13 AS DOUBLE) END AS precip_mm
        FROM events WHERE event_type <> 'purchase'""",
    "v_curve": """
        SELECT CAST(c_custkey AS VARCHAR) AS site, k * CAST(25 AS DOUBLE) AS head_mm,
            pow(k * CAST(25 AS DOUBLE), 1.5) / 100.0 * (1 + c_nationkey / CAST(100 AS DOUBLE)) AS flow_lps
        FROM customer, range(0, 21) r(k)""",
    "v_bins": f"""
        SELECT r.site, time_bucket(INTERVAL '{GRID_MINUTES} minutes', ts) AS ts,
            avg(level_mm - weir_height_mm) AS head_mm, sum(precip_mm) AS precip_mm
        FROM v_readings r JOIN v_sites s ON r.site = s.site GROUP BY 1, 2""",
    "v_gauged": """
        SELECT coalesce(p.site, h.site) AS site, coalesce(p.ts, h.ts) AS ts, p.precip_mm, h.head_mm
        FROM (SELECT s.site, b.ts, b.precip_mm FROM v_bins b JOIN v_sites s ON b.site = s.raingauge) p
        FULL JOIN v_bins h ON p.site = h.site AND p.ts = h.ts""",
    "v_segments": """
        SELECT site, head_mm AS h0, flow_lps AS f0, lead(head_mm) OVER w AS h1, lead(flow_lps) OVER w AS f1
        FROM v_curve WINDOW w AS (PARTITION BY site ORDER BY head_mm)""",
    "v_record": """
        SELECT g.site, g.ts, g.precip_mm, g.head_mm, CAST(NULL AS DOUBLE) AS inflow_lps,
            CASE WHEN h1 IS NULL THEN f0 ELSE f0 + (f1 - f0) / (h1 - h0) * (head_mm - h0) END AS flow_lps
        FROM v_gauged g LEFT JOIN v_segments c ON g.site = c.site AND g.head_mm >= c.h0
            AND (g.head_mm < c.h1 OR (c.h1 IS NULL AND g.head_mm = c.h0))""",
    "v_labelled": f"""
        SELECT *, CAST(sum(CASE WHEN prev IS NULL OR {_epoch("ts")} - {_epoch("prev")} > 21600000000 THEN 1 ELSE 0 END)
            OVER (PARTITION BY site ORDER BY ts) AS INT) AS storm_number
        FROM (SELECT *, lag(ts) OVER (PARTITION BY site ORDER BY ts) AS prev FROM v_record
            WHERE precip_mm > 0 OR flow_lps > 0) w""",
    "v_stats": f"""
        SELECT *, (epoch_us(end_date) - epoch_us(start_date)) / 3.6e9 AS duration_hours,
            (epoch_us(start_date) - epoch_us(lag(end_date) OVER (PARTITION BY site ORDER BY storm_number))) / 8.64e10 AS antecedent_days,
            (epoch_us(peak_outflow_time) - epoch_us(peak_precip_time)) / 3.6e9 AS peak_lag_hours,
            (flow_centroid - rain_centroid) / 3600.0 AS centroid_lag_hours
        FROM (SELECT site, storm_number, min(ts) AS start_date, max(ts) + INTERVAL '{GRID_MINUTES} minutes' AS end_date,
                max(precip_mm) * 6 AS peak_precip_intensity, sum(precip_mm) AS total_precip_depth,
                CASE WHEN max(flow_lps) > 0 THEN sum(flow_lps) * 0.6 END AS total_outflow_m3,
                CASE WHEN max(flow_lps) > 0 THEN max(flow_lps) END AS peak_outflow,
                max(CASE WHEN rain_rank = 1 AND precip_mm > 0 THEN ts END) AS peak_precip_time,
                max(CASE WHEN flow_rank = 1 AND flow_lps > 0 THEN ts END) AS peak_outflow_time,
                sum(epoch_us(ts) / 1e6 * precip_mm) / nullif(sum(precip_mm), 0) AS rain_centroid,
                sum(epoch_us(ts) / 1e6 * flow_lps) / nullif(sum(flow_lps), 0) AS flow_centroid
            FROM (SELECT *,
                    row_number() OVER (PARTITION BY site, storm_number ORDER BY precip_mm DESC NULLS LAST, ts) AS rain_rank,
                    row_number() OVER (PARTITION BY site, storm_number ORDER BY flow_lps DESC NULLS LAST, ts) AS flow_rank
                FROM v_labelled) l
            GROUP BY 1, 2) g""",
    "v_storm_table": f"""
        SELECT t.site, storm_number, year, season, grouped_season, antecedent_days, start_date, end_date,
            duration_hours, peak_precip_intensity, total_precip_depth, runoff_m3, bypass_m3,
            greatest(0.0, runoff_m3 - bypass_m3) AS inflow_m3, outflow_m3,
            outflow_m3 / (total_area + bmp_area) * 1000 AS outflow_mm, peak_outflow, centroid_lag_hours,
            peak_lag_hours, CASE WHEN outflow_m3 > 0.1 THEN 'Yes' ELSE 'No' END AS has_outflow,
            peak_precip_intensity / 6 * (total_area * (0.05 + 0.9 * impervious_area / total_area) + bmp_area) / 600
                AS sm_est_peak_inflow
        FROM (SELECT s.*, coalesce(total_outflow_m3, 0) AS outflow_m3, total_area, impervious_area, bmp_area,
                pow(10, CAST(1.58 AS DOUBLE) + CAST(0.000667 AS DOUBLE) * peak_precip_intensity + CAST(0.0169 AS DOUBLE) * total_precip_depth) AS runoff_m3,
                greatest(0.0, CAST(-26.4 AS DOUBLE) + CAST(0.184 AS DOUBLE) * peak_precip_intensity + CAST(1.22 AS DOUBLE) * total_precip_depth) AS bypass_m3,
                {groups_sql("start_date")}
            FROM v_stats s JOIN v_sites a ON s.site = a.site) t""",
    "v_raw_samples": """
        SELECT CAST(event_id AS VARCHAR) AS sample, CAST(user_id AS VARCHAR) AS site, ts AS samplestart,
            ts + INTERVAL '4 hours' AS samplestop, CAST(10 AS INT) AS interval_minutes,
            CASE WHEN event_id % 41 = 0 THEN 'Blank' WHEN event_id % 3 = 0 THEN 'Grab' ELSE 'Composite' END AS sampletype,
            CASE WHEN event_id % 10 = 0 THEN 'QA' ELSE 'REGULAR' END AS labtype, event_id % 17 = 0 AS ignore
        FROM events WHERE event_type = 'purchase'""",
    "v_samples": """
        SELECT sample, site, samplestart, samplestop, interval_minutes, lower(sampletype) AS sampletype,
            lower(labtype) AS labtype, ignore
        FROM v_raw_samples WHERE labtype = 'REGULAR' AND NOT ignore""",
    "v_results": f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS sample, {PARAM} AS parameter, {LAB_UNITS} AS units,
            l_tax / 9.7 AS detectionlimit, {QUALIFIER} AS qualifier, {CONCENTRATION} AS concentration
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_lab": f"""
        SELECT s.site, s.sample, s.sampletype, s.samplestart, s.samplestop, s.interval_minutes, r.parameter,
            CASE WHEN r.units = 'CFU/100mL' THEN 'CFU/100 mL' ELSE r.units END AS units, r.detectionlimit,
            r.qualifier, r.concentration, {groups_sql("s.samplestart")}
        FROM v_results r JOIN v_samples s ON r.sample = s.sample WHERE r.parameter <> 'Mystery'""",
    "v_matched_samples": f"""
        SELECT s.*, CASE WHEN s.samplestart <= t.end_date + INTERVAL '{LOOKBACK_HOURS} hours' THEN t.storm_number END AS storm_number
        FROM v_samples s ASOF LEFT JOIN v_stats t ON s.site = t.site AND s.samplestart >= t.start_date""",
    "v_matched_lab": f"""
        SELECT s.*, CASE WHEN s.samplestart <= t.end_date + INTERVAL '{LOOKBACK_HOURS} hours' THEN t.storm_number END AS storm_number
        FROM v_lab s ASOF LEFT JOIN v_stats t ON s.site = t.site AND s.samplestart >= t.start_date""",
    "v_standards": f"""
        SELECT {PARAM} AS parameter, {UNITS} AS units, min(p_retailprice / 99.7) AS lower_limit,
            max(p_retailprice / 99.7) AS upper_limit
        FROM part WHERE p_size <> 50 GROUP BY 1, 2""",
    "v_landuse_raw": f"""
        SELECT l_orderkey * 10 + l_linenumber AS row_id, s_nationkey % 3 AS epa_rain_zone,
            l_suppkey % 3 AS location_code, 'St' || (l_partkey % 3) AS station_name, {LANDUSE} AS primary_landuse,
            CAST(date_trunc('month', l_shipdate) AS DATE) AS start_date, 'outflow' AS station,
            {LANDUSE_PARAM} AS parameter, CASE WHEN l_returnflag = 'N' THEN 'Dissolved' ELSE 'Total' END AS fraction,
            {LANDUSE_UNITS} AS units, {CONCENTRATION} AS res, {QUALIFIER} AS qual,
            {season_sql("date_trunc('month', l_shipdate)")} AS season
        FROM {_LINES}""",
    "v_facility_raw": f"""
        SELECT {CATEGORY} AS category, CASE l_linestatus WHEN 'O' THEN 'outflow' ELSE 'inflow' END AS station,
            s_nationkey % 2 AS epazone, {FACILITY_PARAM} AS parameter, {UNITS} AS units, {CONCENTRATION} AS res,
            CASE WHEN l_discount <= 0.02 THEN 'ND' ELSE '=' END AS qual
        FROM {_LINES}""",
}


def with_views(sql: str, **more: str) -> str:
    """The query with the views it uses (directly or not) in front.

    ``more`` gives extra named subqueries of this query, in order.
    """
    known = {**CTES, **more}
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", text):
            if name in known and name not in order and known[name] is not text:
                need(known[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({known[name]}\n)" for name in order)
    return f"WITH {head}\n{sql.strip()}"
