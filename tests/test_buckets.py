import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import hydro, storms
from freshet.sources import buckets

T0 = dt.datetime(2014, 1, 1)


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcd"), T0 + dt.timedelta(minutes=rng.randrange(200 * 1440)), rng.random() * 9, rng.choice([None, 0.0, 1.0])) for _ in range(4000)]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, level_mm double, precip_mm double")


@pytest.fixture
def stored(spark, tmp_path):
    made = []

    def store(df, name):
        buckets.write_record(df, name, str(tmp_path / name), 8)
        made.append(name)
        return buckets.read_record(spark, name)

    yield store
    for name in made:
        spark.sql(f"DROP TABLE {name}")


def shuffled_scans(df):
    """Exchanges of a plan with the stored rows, or what was kept of them, below and no sum over site-months in between."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    bad = []
    for k, line in enumerate(lines):
        if "Exchange" not in line or "BroadcastExchange" in line:
            continue
        below = []
        for j in range(k + 1, len(lines)):
            if depth[j] <= depth[k]:
                break
            below.append(lines[j])
        if not any("Aggregate" in x for x in below):
            bad.append(line)
    return bad


def test_storms_of_a_stored_record_are_found_without_a_shuffle(spark, stored, readings):
    record = readings.select("site", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "precip_mm").dropDuplicates(["site", "ts"])
    plain = storms.label_wet_bins(record)
    bucketed = storms.label_wet_bins(stored(record, "record_by_month"))
    names = ["site", "ts", "storm_number"]
    assert sorted(map(tuple, bucketed.select(*names).collect())) == sorted(map(tuple, plain.select(*names).collect()))
    assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString() and shuffled_scans(plain)
    assert not shuffled_scans(bucketed)


def test_stored_readings_are_binned_without_a_shuffle(spark, stored, readings):
    sites = spark.createDataFrame([(s, 2, g) for s, g in zip("abcd", "aacc")], "site string, weir_height_mm int, raingauge string")
    plain = hydro.gauged_record(readings, sites)
    bucketed = hydro.gauged_record(stored(readings, "readings_by_month"), sites)

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select("site", "ts", "head_mm", "precip_mm").collect())

    assert rows(bucketed) == rows(plain)
    # what is shuffled are bins, to the sites they go to: no Exchange between the stored readings and their bins
    for df, shuffled in ((bucketed, False), (plain, True)):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        last = max(k for k, line in enumerate(lines) if "Aggregate" in line and "_precip" not in line.split("keys=")[1].split("functions")[0] and "level_mm" in line)
        first = min(k for k, line in enumerate(lines) if "Aggregate" in line and "level_mm" in line)
        assert any("Exchange" in line for line in lines[first : last + 1]) == shuffled


def test_a_site_is_spread_over_buckets(spark, stored, readings):
    df = stored(readings.where("site = 'a'"), "one_site")
    assert df.select(F.input_file_name()).distinct().count() > 3
    assert df.where("month = 24168").count() == readings.where("site = 'a' AND ts < '2014-02-01'").count()
