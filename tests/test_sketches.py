import random

import pytest
from pyspark.sql import functions as F

from freshet.functions.clock import season
from freshet.operators import sketches

PROBS = {"p05": 0.05, "p50": 0.5, "p90": 0.9}


@pytest.fixture(scope="module")
def rows(spark):
    days = spark.range(60_000).select(
        F.when(F.col("id") % 5 < 3, "A").otherwise("B").alias("site"),
        F.timestamp_add("minute", (F.col("id") * 17 % 500_000).cast("int"), F.lit("2011-03-01 00:00:00").cast("timestamp")).alias("samplestart"),
        F.when(F.col("id") % 5 == 4, F.round(F.rand(3) * 9)).otherwise(F.exp(F.randn(4))).alias("v"),
    )
    return days.cache()


def test_merged_sketches_are_as_good_as_direct_ones(spark, rows):
    daily = sketches.sketch_values(rows, ["site"], "v").cache()
    assert daily.count() > 500
    seasons = daily.withColumn("season", season("day"))
    merged = sketches.approx_percentiles(sketches.merge_sketches(seasons, ["site", "season"]), ["site", "season"], PROBS)
    timed = rows.withColumn("season", season("samplestart"))
    direct = sketches.approx_percentiles(
        sketches.merge_sketches(sketches.sketch_values(timed, ["site", "season"], "v", step="year"), ["site", "season"]), ["site", "season"], PROBS
    )
    exact = {(r.site, r.season): r for r in timed.groupBy("site", "season").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    for found in (merged, direct):
        kept = found.cache()
        assert {(r.site, r.season): (r.n, r.min, r.max) for r in kept.collect()} == {k: (r.n, r.lo, r.hi) for k, r in exact.items()}
        for r in sketches.rank_errors(timed, ["site", "season"], "v", kept, PROBS).collect():
            assert max(r[p] for p in PROBS) <= 2 * sketches.rank_error()


def test_small_groups_are_exact(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(101)]
    df = spark.createDataFrame([("A", v) for v in values], "site string, v double").withColumn("samplestart", F.lit("2012-02-29 10:00:00").cast("timestamp"))
    found = sketches.approx_percentiles(sketches.sketch_values(df, ["site"], "v"), ["site"], PROBS).first()
    assert found.p50 == sorted(values)[50] and found.n == 101


def test_nulls_ties_and_no_rows(spark):
    stamp = "2012-01-05 00:00:00"
    rows = [("A", stamp, 2.0)] * 5000 + [("A", stamp, None), (None, stamp, 1.0), ("A", None, 1.0)]
    df = spark.createDataFrame(rows, "site string, t string, v double").withColumn("samplestart", F.col("t").cast("timestamp"))
    daily = sketches.sketch_values(df, ["site"], "v")
    found = sketches.approx_percentiles(sketches.merge_sketches(daily, ["site"]), ["site"], PROBS).collect()
    assert [(r.n, r.min, r.p05, r.p90, r.max) for r in found] == [(5000, 2.0, 2.0, 2.0, 2.0)]
    none = sketches.merge_sketches(sketches.sketch_values(df.limit(0), ["site"], "v"), ["site"])
    assert sketches.approx_percentiles(none, ["site"], PROBS).collect() == []


def test_stored_sketches_are_read_by_year(spark, tmp_path, rows):
    path = str(tmp_path / "daily")
    sketches.write_sketches(sketches.sketch_values(rows, ["site"], "v"), path)
    stored = sketches.read_sketches(spark, path)
    assert stored.agg(F.sum("n")).first()[0] == 60_000
    plan = stored.where("sketch_year = 2011")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sketch_year" in plan
    # a year that is written anew takes the place of the old one, others stay
    again = sketches.sketch_values(rows.where(F.year("samplestart") == 2011), ["site"], "v")
    sketches.write_sketches(again, path)
    assert sketches.read_sketches(spark, path).agg(F.sum("n")).first()[0] == 60_000


def test_error_shrinks_with_size():
    assert sketches.rank_error(800) < sketches.rank_error(400) < sketches.rank_error(200) < 0.0134
