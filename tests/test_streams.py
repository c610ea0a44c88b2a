"""Streams replayed against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freshet.operators import samples, storms
from freshet.streaming import storms as stream

T0 = dt.datetime(2024, 1, 1)
BINS = "site string, ts timestamp, precip_mm double, flow_lps double"


def write_batches(spark, batches, schema, folder):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")


def run(spark, df, folder):
    query = (
        df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def live(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def replayed(rng, shuffle_minutes):
    """Wet bins of three sites in order of arrival, each up to ``shuffle_minutes`` late."""
    rows = []
    for site in "abc":
        at = 0
        for _ in range(120):
            at += rng.choice([10, 10, 10, 20, 360, 370, 1500]) if site != "b" else 360
            rows.append((at + rng.randrange(shuffle_minutes + 1), (site, T0 + dt.timedelta(minutes=at), rng.choice([0.0, 1.0, 2.5, None]), rng.choice([0.5, None, 3.0]))))
    rows.sort(key=lambda r: r[0])
    closing = [(site, T0 + dt.timedelta(days=400 + k), 1.0, 1.0) for k in range(2) for site in "abc"]
    return [r for _, r in rows], closing


@pytest.mark.parametrize("shuffle_minutes", [0, 55])
def test_streamed_storms_equal_the_batch_storm_statistics(spark, tmp_path, shuffle_minutes):
    rows, closing = replayed(random.Random(shuffle_minutes), shuffle_minutes)
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    write_batches(spark, [*batches, closing[:3], closing[3:]], BINS, tmp_path / "bins")
    out = run(spark, stream.numbered_storms(live(spark, BINS, str(tmp_path / "bins")), late="1 hour"), str(tmp_path / "s"))
    names = ["site", "storm_number", "start_date", "end_date", "duration_hours", "antecedent_days", "total_precip_depth",
             "peak_precip_intensity", "total_outflow_m3", "peak_outflow"]
    batch = storms.storm_stats(storms.label_wet_bins(spark.createDataFrame(rows, BINS))).select(*names)

    def key(r):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in r)

    found = {key(r) for r in out.select(*names).collect() if r.start_date < T0 + dt.timedelta(days=300)}
    wanted = {tuple(0.0 if v is None and n in ("total_precip_depth", "peak_precip_intensity") else v for n, v in zip(names, key(r))) for r in batch.collect()}
    assert found == wanted and len(found) > 20


def test_a_storm_closes_without_another_bin_of_its_site(spark, tmp_path):
    first = [("a", T0, 1.0, None), ("a", T0 + dt.timedelta(minutes=10), 2.0, None)]
    write_batches(spark, [first, [("z", T0 + dt.timedelta(days=3), 1.0, None)], [("z", T0 + dt.timedelta(days=3), 1.0, None)]], BINS, tmp_path / "bins")
    out = run(spark, stream.numbered_storms(live(spark, BINS, str(tmp_path / "bins"))), str(tmp_path / "s")).collect()
    assert [(r.site, r.storm_number, r.total_precip_depth, r.antecedent_days, r.total_outflow_m3) for r in out] == [("a", 1, 3.0, None, None)]


def test_streamed_samples_equal_the_batch_match(spark, tmp_path):
    rng, hour = random.Random(5), dt.timedelta(hours=1)
    rows = [(s, k + 1, T0 + 40 * k * hour, T0 + (40 * k + rng.randrange(1, 20)) * hour) for s in "ab" for k in range(12)]
    taken = [(f"{k}", rng.choice("abc"), T0 + dt.timedelta(minutes=rng.randrange(-60, 480 * 60)), "composite") for k in range(80)]
    taken.sort(key=lambda r: r[2])
    far = T0 + dt.timedelta(days=900)
    s_schema, t_schema = "site string, storm_number int, start_date timestamp, end_date timestamp", "sample string, site string, samplestart timestamp, sampletype string"
    rows.sort(key=lambda r: r[3])
    write_batches(spark, [rows[:12], rows[12:], [("z", 1, far, far)], [("z", 2, far + 60 * 24 * hour, far + 60 * 24 * hour)]], s_schema, tmp_path / "storms")
    write_batches(spark, [taken[:40], taken[40:], [("x", "z", far + hour * 5, "grab")], [("y", "z", far + 70 * 24 * hour, "grab")]], t_schema, tmp_path / "samples")
    joined = stream.samples_in_storms(
        live(spark, t_schema, str(tmp_path / "samples")), live(spark, s_schema, str(tmp_path / "storms")), lookback_hours=6
    )
    out = [(r.sample, r.site, r.samplestart, r.storm_number) for r in run(spark, joined, str(tmp_path / "j")).where(F.col("site") != "z").collect()]
    batch = samples.match_storms(spark.createDataFrame(taken, t_schema), spark.createDataFrame(rows, s_schema), lookback_hours=6)
    wanted = [(r["sample"], r["site"], r["samplestart"], r["storm_number"]) for r in batch.collect()]
    assert len(out) == len(set(out)) and set(out) == set(wanted)
    assert {n is None for *_, n in out} == {True, False}
