"""Samples: scans, matching to storms, and the lists derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.functions import options, pollutants
from freshet.functions.clock import day_index, plus_minutes, with_time_groups
from freshet.operators.intervals import join_on_grid


def regular_samples(samples: DataFrame) -> DataFrame:
    """Samples of the regular lab type that are not ignored, types in lower case."""
    return samples.filter((F.col("labtype") == "REGULAR") & ~F.col("ignore")).withColumns(
        {"sampletype": F.lower("sampletype"), "labtype": F.lower("labtype")}
    )


def wq_results(results: DataFrame, samples: DataFrame, only_known: bool = True) -> DataFrame:
    """Lab results with their sample, time groups and corrected units."""
    info = regular_samples(samples).select(
        "sample", "site", "sampletype", "samplestart", "samplestop", "interval_minutes"
    )
    wanted = pollutants.keep_pollutants(results) if only_known else results
    joined = wanted.join(info, "sample", "inner").select(
        "site", "sample", "sampletype", "samplestart", "samplestop", "interval_minutes",
        "parameter", "units", "detectionlimit", "qualifier", "concentration",
    )
    return pollutants.fix_units(
        with_time_groups(joined, "samplestart"), pollutants.OWN_BACTERIA_SPELLINGS
    )


def sample_dates(samples: DataFrame, sampletype: str, which: str = "start") -> DataFrame:
    """Start or end times of the samples of one type."""
    ends = {"start": "samplestart", "end": "samplestop", "stop": "samplestop"}
    if which.lower() not in ends:
        raise ValueError(f"which must be one of {tuple(ends)}")
    return samples.filter(F.col("sampletype") == options.sample_type(sampletype)).select(
        "site", "sample", F.col(ends[which.lower()]).alias("sampledate")
    )


def match_storms(
    points: DataFrame, storms: DataFrame, ts: str = "samplestart", lookback_hours: float = 6
) -> DataFrame:
    """Add the ``storm_number`` a time belongs to: the last storm begun by
    then, if it ended no more than ``lookback_hours`` ago; else null.

    Both ends count as inside. The join key is (site, day), so samples of a
    busy site meet only the storms around their own day. Storms of a site do
    not overlap; a lookback longer than the dry gap between two storms lets
    two match, and the later start wins.
    """
    spans = storms.select(
        "site",
        F.col("storm_number").alias("_number"),
        F.col("start_date").alias("_start"),
        plus_minutes("end_date", lookback_hours * 60).alias("_until"),
    )
    inside = (F.col(ts) >= F.col("_start")) & (F.col(ts) <= F.col("_until"))
    # later storms cut earlier ones short, so at most one span holds a time
    following = F.lead("_start").over(Window.partitionBy("site").orderBy("_number"))
    spans = spans.withColumn("_next", following)
    only_last = inside & (F.col("_next").isNull() | (F.col(ts) < F.col("_next")))
    return (
        join_on_grid(points, spans, ["site"], day_index(ts), day_index("_start"), day_index("_until"), only_last)
        .withColumnRenamed("_number", "storm_number")
        .drop("_start", "_until", "_next")
    )


def storms_with_samples(storms: DataFrame, matched: DataFrame, sampletype: str = "composite") -> DataFrame:
    """Storms in which a sample of the type was taken, in order."""
    return _listed(storms.join(_sampled_keys(matched, sampletype), ["site", "storm_number"], "left_semi"))


def storms_without_samples(storms: DataFrame, matched: DataFrame, sampletype: str = "composite") -> DataFrame:
    """Storms in which no sample of the type was taken, in order."""
    return _listed(storms.join(_sampled_keys(matched, sampletype), ["site", "storm_number"], "left_anti"))


def _listed(storms: DataFrame) -> DataFrame:
    return storms.orderBy("site", "storm_number")


def _sampled_keys(matched: DataFrame, sampletype: str) -> DataFrame:
    wanted = options.sample_type(sampletype)
    return (
        matched.filter((F.col("sampletype") == wanted) & F.col("storm_number").isNotNull())
        .select("site", "storm_number")
        .distinct()
    )


def storm_sample_dates(matched: DataFrame, sampletype: str = "any", ts: str = "samplestart") -> DataFrame:
    """One row per sample taken in a storm: ``site, storm_number, sampledate``.

    ``sampletype`` is 'grab', 'comp' or 'any'. Storms without samples have
    no rows.
    """
    kinds = {"grab": ["grab"], "comp": ["composite"], "any": ["grab", "composite"]}
    if sampletype not in kinds:
        raise ValueError(f"sampletype must be one of {tuple(kinds)}")
    return matched.filter(
        F.col("sampletype").isin(kinds[sampletype]) & F.col("storm_number").isNotNull()
    ).select("site", "storm_number", "sampletype", F.col(ts).alias("sampledate"))


def unknown_sites(requested: DataFrame, sites: DataFrame) -> DataFrame:
    """Requested sites that are not in the site table."""
    return requested.select("site").distinct().join(sites, "site", "left_anti")


def require_sites(requested: DataFrame, sites: DataFrame) -> None:
    """Raise an error if requested sites do not exist: how many, and the first of them.

    :func:`unknown_sites` has them all.
    """
    # both in one pass: a sort of twenty per task, and sums that merge before they meet
    seen = Observation()
    first = unknown_sites(requested, sites).observe(seen, F.count(F.lit(1)).alias("n")).orderBy("site").limit(20).collect()
    if first:
        names, n = [r["site"] for r in first], seen.get["n"]
        raise ValueError(f"{n} unknown sites: {names}" + (f" and {n - len(names)} more" if n > len(names) else ""))


def bad_sample_types(samples: DataFrame) -> DataFrame:
    """Samples whose type is neither grab nor composite."""
    known = F.lower("sampletype").isin(*options.SAMPLE_TYPES)
    return samples.filter(~F.coalesce(known, F.lit(False)))


def unknown_parameters(results: DataFrame) -> DataFrame:
    """Parameters missing from the dictionary, with their row counts."""
    known = F.col("parameter").isin(*pollutants.names())
    return (
        results.filter(~F.coalesce(known, F.lit(False)))
        .groupBy("parameter")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def repeated_composites(matched: DataFrame) -> DataFrame:
    """Storms with more than one composite sample; their loads count twice."""
    return (
        matched.filter((F.col("sampletype") == "composite") & F.col("storm_number").isNotNull())
        .groupBy("site", "storm_number")
        .agg(F.countDistinct("sample").alias("composites"))
        .filter("composites > 1")
    )

