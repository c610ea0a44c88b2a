"""Report-ready text tables for all storms and samples at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions import options
from freshet.functions.numbers import with_units

VERSIONS = ("draft", "final")


def file_stem(name: Column) -> Column:
    """A name with the characters that file names avoid taken out."""
    return F.regexp_replace(name, "[^A-Za-z0-9.\\-]", "")


def _stamp(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HHmm")


def _kind(sampletype: Column) -> Column:
    return F.initcap(sampletype)


def artefact_names(samples: DataFrame) -> DataFrame:
    """Names of the tables and the figure of each sample's report."""
    stem = F.concat_ws("-", F.col("site").cast("string"), _stamp("samplestart"))
    kind = _kind(F.col("sampletype"))
    return samples.withColumns(
        {
            "general_table": file_stem(F.concat(stem, F.lit("-1-General"))),
            "hydro_table": file_stem(F.concat(stem, F.lit("-2-Hydro"))),
            "wq_table": file_stem(F.concat(stem, F.lit("-3-WQ_"), kind)),
            "storm_figure": file_stem(F.concat(stem, F.lit("-"), kind)),
        }
    )


def wq_tables(tidy: DataFrame, standards: DataFrame, keys: tuple[str, ...] = ("site", "sample")) -> DataFrame:
    """Guideline, detection limit, concentration and load of every sample as text.

    E. coli and parameters without a guideline are left out. Repeated rows of a
    sample are merged.
    """
    guideline = standards.select("parameter", F.col("upper_limit").alias("_guideline"))
    return (
        tidy.filter(F.col("parameter") != "Escherichia coli")
        .join(guideline, "parameter", "inner")
        # numbers are shuffled, not texts: they are written out by all tasks, and equal texts meet where they are written
        .select(*keys, "parameter", "units", "load_units", "_guideline", "detectionlimit", "concentration", "load_outflow")
        .repartition(*keys, "parameter")
        .select(
            *keys,
            "parameter",
            with_units("_guideline", "units").alias("wq_guideline"),
            with_units("detectionlimit", "units").alias("detection_limit"),
            with_units("concentration", "units").alias("effluent_emc"),
            with_units("load_outflow", "load_units").alias("effluent_load"),
        )
        .dropDuplicates()
    )


def _fixed(column: str, digits: int) -> Column:
    # rounded first, so that ties go up rather than to even
    v = F.col(column).cast("double")
    return F.format_string(f"%.{digits}f", F.round(v, digits))


def hydro_tables(storms: DataFrame, names: DataFrame | None = None, lag: str = "peak_lag_hours") -> DataFrame:
    """Per storm, the ten labelled lines of the hydrology table.

    One row per line: ``site, storm_number, ord, label, text``. ``names``
    (``site, sitename``) gives the site's full name.
    """
    named = storms if names is None else storms.join(names.select("site", "sitename"), "site", "left")
    title = F.col("site").cast("string") if names is None else F.coalesce("sitename", F.col("site").cast("string"))

    def measured(column: str, digits: int, units: str) -> Column:
        known = F.concat(_fixed(column, digits), F.lit(f" {units}"))
        return F.when(F.col(column).isNull(), f"-- {units}").otherwise(known)

    # --- fixed values: labels and units of the report lines ---
    lines = (
        ("Site", title),
        ("Event Date", F.date_format("start_date", "yyyy-MM-dd HH:mm")),
        ("Antecedent Dry Period", measured("antecedent_days", 1, "days")),
        ("Event Duration", measured("duration_hours", 1, "hr")),
        ("Peak Effluent Flow", measured("peak_outflow", 1, "L/s")),
        ("Peak Precipitation Intensity", measured("peak_precip_intensity", 0, "mm/hr")),
        ("Lag Time", measured(lag, 1, "hr")),
        ("Estimated Total Influent Volume", measured("inflow_m3", 0, "m$^3$")),
        ("Total Effluent Volume", measured("outflow_m3", 0, "m$^3$")),
        ("Total Precipitation", measured("total_precip_depth", 1, "mm")),
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), text.alias("text"))
            for i, (label, text) in enumerate(lines, 1)
        ]
    )
    return named.select("site", "storm_number", F.explode(rows).alias("_l")).select(
        "site", "storm_number", "_l.*"
    )


def report_worklist(matched: DataFrame, sampletype: str, version: str = "draft") -> DataFrame:
    """Samples of a type that fall in a storm, with the names of their report."""
    if version.lower() not in VERSIONS:
        raise ValueError(f"version must be one of {VERSIONS}")
    rows = matched.filter(
        (F.col("sampletype") == options.sample_type(sampletype)) & F.col("storm_number").isNotNull()
    )
    document = F.concat_ws(
        "-",
        F.col("site").cast("string"),
        F.date_format("samplestart", "yyyyMMdd-HHmm"),
        _kind(F.col("sampletype")),
        F.lit(f"ISR-{version.lower()}"),
    )
    return artefact_names(rows).withColumn("document", file_stem(document))
