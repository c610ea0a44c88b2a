"""Tidy water-quality tables: concentrations, storms and loads side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import options, pollutants
from freshet.functions.volumes import load
from freshet.operators import censored
from freshet.operators.lineage import broadcast_if_small, cut, marked

BOUNDS = ("lower", "median", "upper")
INFLUENT = tuple(f"influent_{b}" for b in BOUNDS)
EFFLUENT = tuple(f"effluent_{b}" for b in BOUNDS)
_SUFFIX = {"lower": "_lower", "median": "", "upper": "_upper"}
_MATCH = ("site", "storm_number", "year", "season", "grouped_season")
# --- fixed values: column order of the tidy tables (below and in tidy_measured) ---
_SAMPLE_COLUMNS = (
    "sample", "sampletype", "samplestart", "samplestop", "interval_minutes",
    "detectionlimit", "qualifier", "concentration",
)


def _influent_loads() -> dict:
    return {
        f"load_{part}{_SUFFIX[b]}": load("load_factor", f"{part}_m3", f"influent_{b}")
        for part in ("runoff", "bypass", "inflow")
        for b in BOUNDS
    }


def _with_load_terms(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "load_units": pollutants.attribute("parameter", "load_units"),
            "load_factor": pollutants.attribute("parameter", "load_factor"),
        }
    )


def _median_keys(medians: DataFrame) -> list[str]:
    keys = ["parameter", "season", "units"]
    return (["site"] if "site" in medians.columns else []) + keys


def tidy_measured(matched: DataFrame, storms: DataFrame, influent: DataFrame | None = None) -> DataFrame:
    """Every storm with the results of its samples and their loads.

    ``matched`` has the results with a ``storm_number`` (see
    :func:`freshet.operators.samples.match_storms`). Storms without samples
    keep one row with no parameter. ``influent`` (parameter, season, units
    and ``influent_*``, per site if it has a ``site`` column) is joined where
    it matches; influent rows that match no storm have no site and are left out.
    """
    wq = matched.filter(F.col("storm_number").isNotNull())
    df = _with_load_terms(storms.join(wq, list(_MATCH), "left"))
    if influent is None:
        df = df.withColumns({c: F.lit(None).cast("double") for c in INFLUENT})
    else:
        keys = _median_keys(influent)
        df = df.join(influent.select(*keys, *INFLUENT), keys, "left")
    df = df.withColumns(
        {**_influent_loads(), "load_outflow": load("load_factor", "outflow_m3", "concentration")}
    )
    return df.select(
        "site", "sample", "sampletype", "season", "grouped_season", "year", "samplestart",
        "samplestop", "interval_minutes", "parameter", "units", "detectionlimit", "qualifier",
        "concentration", *INFLUENT, "storm_number", "antecedent_days", "start_date", "end_date",
        "duration_hours", F.col("peak_precip_intensity").alias("peak_precip_intensity_mm_per_hr"),
        F.col("total_precip_depth").alias("total_precip_depth_mm"),
        "runoff_m3", "bypass_m3", "inflow_m3", "outflow_m3",
        F.col("peak_outflow").alias("peak_outflow_L_per_s"), "centroid_lag_hours", "peak_lag_hours",
        *_influent_loads(), "load_outflow", "load_units", "load_factor",
    )


def tidy_loads(
    wq: DataFrame,
    storms: DataFrame,
    influent: DataFrame,
    effluent: DataFrame,
    keep_unmatched: bool = True,
) -> DataFrame:
    """Every storm times every parameter of its site, with loads.

    Measured composite results are used where a storm has one, typical
    effluent where it has not; those rows are marked 'unsampled'. ``wq`` has
    all results of all types with their ``storm_number``; ``influent`` and
    ``effluent`` are per site (see :func:`assign_influent`). With ``keep_unmatched`` (default) the rows that fit no storm stay:
    samples outside storms, and medians no storm needs, which have no site.

    ``storms`` and ``wq`` are read several times: pass stored tables, or cut
    their lineage (:func:`freshet.operators.lineage.cut`).
    """
    if "site" not in influent.columns:
        raise ValueError("influent medians need a site column; see assign_influent")
    # parameters come from the dictionary, so a site has at most sixteen
    params = broadcast_if_small(
        pollutants.keep_pollutants(wq)
        .select("site", "parameter")
        .distinct()
        .withColumn("units", pollutants.attribute("parameter", "conc_units"))
    )
    keys = ["site", "parameter", "season", "units"]
    medians = cut(
        influent.select(*keys, *INFLUENT).join(effluent.select(*keys, *EFFLUENT), keys, "full")
    )
    estimated = storms.join(params, "site", "inner").join(marked(medians), keys, "left")
    composite = wq.filter(F.col("sampletype") == "composite").select(
        *_MATCH, "parameter", "units", *_SAMPLE_COLUMNS
    )
    in_storm = composite.filter(F.col("storm_number").isNotNull())
    df = estimated.join(in_storm, [*_MATCH, "parameter", "units"], "full" if keep_unmatched else "left")
    if keep_unmatched:
        needed = storms.select("site", "season").distinct().join(params, "site", "inner")
        unused = medians.join(needed, keys, "left_anti").drop("site")
        outside = composite.filter(F.col("storm_number").isNull())
        for rest in (unused, outside):
            df = df.unionByName(rest, allowMissingColumns=True)
    df = _with_load_terms(df).withColumns(
        {
            **_influent_loads(),
            **{
                f"load_outflow{_SUFFIX[b]}": load("load_factor", "outflow_m3", "concentration", f"effluent_{b}")
                for b in BOUNDS
            },
            "sampletype": F.coalesce("sampletype", F.lit("unsampled")),
        }
    )
    return df.select(
        *storms.columns, "parameter", "units", *_SAMPLE_COLUMNS, *INFLUENT, *EFFLUENT,
        "load_units", "load_factor", *_influent_loads(),
        *[f"load_outflow{_SUFFIX[b]}" for b in BOUNDS],
    )


def _effluent_groups(wq: DataFrame, rescol: str, sampletype: str, groupby_col: str | None) -> tuple[DataFrame, list[str]]:
    rescol, unitscol = options.result_column(rescol)
    extra = options.time_group(groupby_col)
    rows = wq.filter(F.col("sampletype") == options.sample_type(sampletype))
    return rows, ["site", "parameter", unitscol, *([extra] if extra else [])]


def site_medians(
    wq: DataFrame, rescol: str = "concentration", sampletype: str = "composite", groupby_col: str | None = None
) -> DataFrame:
    """Median with bounds per site, parameter, units [and time], non-detects estimated."""
    rows, by = _effluent_groups(wq, rescol, sampletype, groupby_col)
    medians = censored.median_bounds(rows, by, rescol.lower())
    return medians.select(*by, *[F.col(b).alias(f"effluent_{b}") for b in BOUNDS])


def site_effluent(
    wq: DataFrame,
    samples: DataFrame,
    rescol: str = "concentration",
    sampletype: str = "composite",
    groupby_col: str | None = None,
) -> DataFrame:
    """Characteristic effluent per site, parameter, units [and time].

    ``samples`` decides which sites have enough composite samples (see
    :func:`freshet.operators.censored.characteristic_effluent`).
    """
    rows, by = _effluent_groups(wq, rescol, sampletype, groupby_col)
    composites = samples.filter(F.col("sampletype") == "composite")
    return censored.characteristic_effluent(rows, by[1:], composites, rescol.lower())


def rename_influent(medians: DataFrame) -> DataFrame:
    """Use a table of medians as influent: ``median`` -> ``influent_median``..."""
    names = {}
    for c in medians.columns:
        short = c.removeprefix("effluent_")
        if short in BOUNDS:
            names[c] = f"influent_{short}"
    return medians.withColumnsRenamed(names)


def assign_influent(medians: DataFrame, sources: DataFrame) -> DataFrame:
    """Influent medians per site.

    ``medians`` has a ``source`` (a reference site or an external data set);
    ``sources`` (``site, source``) says which one each site uses.
    """
    return rename_influent(sources.select("site", "source").join(medians, "source", "inner")).drop("source")


def unsampled_estimates(tidy: DataFrame) -> DataFrame:
    """Volumes and estimated loads of unsampled storms, summed."""
    sums = (
        "duration_hours", "total_precip_depth", "runoff_m3", "bypass_m3", "inflow_m3", "outflow_m3",
        "load_runoff", "load_bypass", "load_inflow", "load_outflow",
    )
    by = ["site", "season", "has_outflow", "parameter", "load_units"]
    return (
        tidy.filter(F.col("sampletype") == "unsampled")
        .na.drop(subset=by)
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
