"""Approximate percentiles from mergeable sketches: an opt-in beside the exact ones.

A KLL sketch of a group has a bounded size whatever the group's, and sketches
of parts merge into one of the whole. Daily sketches, stored once, therefore
give the percentiles of any month, season or year without the rows. The
exact percentiles (``operators.spread``) stay the default everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators.spread import drop_null_keys

#: Size parameter of the sketches: a larger one has a smaller error.
K = 400


def rank_error(k: int = K) -> float:
    """Share of the rows by which the rank of a percentile may be off, in 99 of 100 cases (from the paper's implementation)."""
    return 2.296 / k**0.9723


def sketch_values(
    df: DataFrame, by: Sequence[str], value: str, time: str = "samplestart", k: int = K, step: str = "day"
) -> DataFrame:
    """One sketch per group and ``step`` of ``time``: ``by``, ``day``, ``sketch``, ``n``, ``min``, ``max``.

    Rows without a value, a time or a group key are left out. A sketch of few
    rows holds them all. Values are merged into sketches before the shuffle.
    """
    known = drop_null_keys(df, [*by, time]).na.drop(subset=[value])
    number = F.col(value).cast("double")
    return known.groupBy(*by, F.to_date(F.date_trunc(step, F.col(time))).alias("day")).agg(
        F.kll_sketch_agg_double(number, k).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(number).alias("min"), F.max(number).alias("max")
    )


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store sketches by year, so that a roll-up of some years reads those alone. Written years are replaced."""
    dated = sketches.withColumn("sketch_year", F.year("day"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sketch_year").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_sketches(sketches: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups: ``by``, ``sketch``, ``n``, ``min``, ``max``; ``by`` may be any columns made from ``day``.

    Sketches of groups with a null key are left out, as their rows would be.
    """
    return drop_null_keys(sketches, by).groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max")
    )


def percentile_columns(probs: dict[str, float], sketch: str = "sketch") -> list[Column]:
    """One column per named percentile: a value of the group whose rank is near it."""
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))).alias(name) for name, p in probs.items()]


def approx_percentiles(sketches: DataFrame, by: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Percentiles per group, with ``n``, ``min`` and ``max``, which are exact."""
    return sketches.select(*by, "n", "min", "max", *percentile_columns(probs))


def rank_errors(df: DataFrame, by: Sequence[str], value: str, found: DataFrame, probs: dict[str, float]) -> DataFrame:
    """How far the rank of each percentile of ``found`` is from the rank asked for, as a share of the rows.

    A value held by several rows has all their ranks; the nearest counts.
    """
    rows = drop_null_keys(df, by).na.drop(subset=[value]).select(*by, F.col(value).cast("double").alias("_v"))
    joined = rows.join(found.select(*by, *[F.col(c).alias(f"_{c}") for c in probs]), list(by))
    errors = []
    for name, p in probs.items():
        below = F.avg((F.col("_v") < F.col(f"_{name}")).cast("double"))
        upto = F.avg((F.col("_v") <= F.col(f"_{name}")).cast("double"))
        errors.append(F.greatest(below - p, p - upto, F.lit(0.0)).alias(name))
    return joined.groupBy(*by).agg(*errors)
