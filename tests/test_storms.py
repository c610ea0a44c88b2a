"""Records, storms and samples."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freshet.functions import volumes
from freshet.operators import hydro, samples, storms
from freshet.operators.intervals import join_on_grid

T0 = dt.datetime(2024, 1, 30, 0, 0)
RECORD = "site string, ts timestamp_ntz, precip_mm double, flow_lps double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def record(spark, rows):
    return spark.createDataFrame([(s, at(m), p, q) for s, m, p, q in rows], RECORD)


def brute_labels(rows, gap_minutes=360, period=10):
    out, last, number = {}, {}, {}
    for s, m, p, q in sorted(rows, key=lambda r: (r[0], r[1])):
        if not ((p or 0) > 0 or (q or 0) > 0):
            continue
        if s not in last or m - (last[s] + period) >= gap_minutes:
            number[s] = number.get(s, 0) + 1
        last[s] = m
        out[s, at(m)] = number[s]
    return out


def test_labels_match_brute_force_over_month_ends(spark):
    rng = random.Random(3)
    rows = []
    for site in ("a", "b", "quiet"):
        for b in sorted(rng.sample(range(0, 18000), 900)):  # 125 days of bins, five months
            wet = rng.random() < (0.02 if site == "quiet" else 0.25)
            rows.append((site, b * 10, 0.2 if wet and rng.random() < 0.8 else 0.0, 1.5 if wet else None))
    labelled = storms.label_wet_bins(record(spark, rows))
    assert {(r["site"], r["ts"]): r["storm_number"] for r in labelled.collect()} == brute_labels(rows)


def test_gap_is_measured_from_the_end_of_the_last_wet_bin(spark):
    rows = [("a", 0, 1.0, None), ("a", 360, 1.0, None), ("a", 730, 1.0, None)]
    got = {r["ts"]: r["storm_number"] for r in storms.label_wet_bins(record(spark, rows)).collect()}
    assert got == {at(0): 1, at(360): 1, at(730): 2}


def test_labels_agree_with_session_windows(spark):
    rng = random.Random(9)
    rows = [("a", 10 * b, 0.4, None) for b in rng.sample(range(0, 20000), 700)]
    df = record(spark, rows)
    ours = storms.storm_stats(storms.label_wet_bins(df)).select("start_date").collect()
    sessions = df.groupBy(F.session_window("ts", "6 hours").alias("s")).agg(F.min("ts").alias("t")).select("t").collect()
    assert sorted(r[0] for r in ours) == sorted(r[0] for r in sessions)


def test_storm_statistics(spark):
    rows = [
        ("a", 0, 0.2, None), ("a", 10, 1.0, 2.0), ("a", 20, 1.0, 4.0), ("a", 30, 0.0, 4.0), ("a", 40, 0.0, 0.0),
        ("a", 1000, 0.2, None),
    ]
    first, second = storms.storm_stats(storms.label_wet_bins(record(spark, rows))).orderBy("storm_number").collect()
    assert (first["start_date"], first["end_date"]) == (at(0), at(40))
    assert first["duration_hours"] == pytest.approx(40 / 60)
    assert first["peak_precip_intensity"] == pytest.approx(6.0)
    assert first["total_precip_depth"] == pytest.approx(2.2)
    assert first["total_outflow_m3"] == pytest.approx(10 * 600 / 1000)
    assert first["total_inflow_m3"] is None
    assert first["peak_lag_hours"] == pytest.approx(10 / 60)  # equal peaks: the earliest counts
    rain = (0 * 0.2 + 10 * 1.0 + 20 * 1.0) / 2.2
    flow = (10 * 2.0 + 20 * 4.0 + 30 * 4.0) / 10
    assert first["centroid_lag_hours"] == pytest.approx((flow - rain) / 60, abs=1e-6)
    assert first["antecedent_days"] is None and second["antecedent_days"] == pytest.approx(960 / 1440)
    assert second["duration_hours"] == pytest.approx(1 / 6)
    assert (second["peak_outflow"], second["peak_lag_hours"], second["centroid_lag_hours"]) == (None, None, None)
    assert second["peak_precip_intensity"] == pytest.approx(1.2)
    strong = storms.storm_stats(storms.label_wet_bins(record(spark, rows)), min_precip=2.0).collect()
    assert [r["storm_number"] for r in strong] == [1]


def test_edits_mute_and_shift(spark):
    rows = [("a", m, 1.0, None) for m in (0, 10, 20, 30, 40, 1000, 2000)] + [("b", 0, 1.0, None)]
    edits = spark.createDataFrame([("a", at(20), at(30), at(40))], "site string, mute_from timestamp_ntz, mute_to timestamp_ntz, shift_from timestamp_ntz")
    got = {(r["site"], r["ts"]): r["storm_number"] for r in storms.label_wet_bins(record(spark, rows), edits=edits).collect()}
    assert got == {
        ("a", at(0)): 1, ("a", at(10)): 1, ("a", at(20)): 0, ("a", at(30)): 0, ("a", at(40)): 2,
        ("a", at(1000)): 3, ("a", at(2000)): 4, ("b", at(0)): 1,
    }


# --- fixed values: the known storms of one site ---
STORM_FIELDS = "start_date end_date season grouped_season depth peak outflow_m3 runoff_m3 bypass_m3 inflow_m3 outflow_mm sm_est_peak_inflow has_outflow"
KNOWN_STORMS = """
2012-07-31 11:50:00,2012-07-31 22:30:00,summer,summer/autumn,35.0,63.6,51.70739999999944,190.54607179632484,42.699999999999996,147.84607179632485,8.009200743494336,58.02175,Yes
2012-08-04 19:40:00,2012-08-04 19:50:00,summer,summer/autumn,0.2,1.2,0.0,38.37072454922788,0.244,38.12672454922788,0.0,1.09475,No
2012-08-05 03:00:00,2012-08-05 04:00:00,summer,summer/autumn,0.6000000000000001,2.4,0.0,39.084089579240214,0.7320000000000001,38.352089579240214,0.0,2.1895,No
2012-08-05 12:20:00,2012-08-05 14:30:00,summer,summer/autumn,1.2,2.4,0.0,40.179081084894,1.464,38.715081084894,0.0,2.1895,No
2012-08-09 09:00:00,2012-08-11 16:50:00,summer,summer/autumn,55.99999999999999,55.2,103.79159999999779,501.18723362727246,68.32,432.86723362727247,16.07676579925616,50.3585,Yes
2013-03-07 13:30:00,2013-03-07 13:40:00,winter,winter/spring,0.2,1.2,0.0,38.37072454922788,0.244,38.12672454922788,0.0,1.09475,No
2013-03-07 22:00:00,2013-03-08 05:10:00,winter,winter/spring,1.4000000000000001,1.2,0.0,40.55085354483839,1.7080000000000002,38.84285354483839,0.0,1.09475,No
2013-03-10 14:20:00,2013-03-13 01:30:00,winter,winter/spring,10.200000000000001,2.4,71.82479999999707,60.81350012787179,12.444,48.36950012787179,11.125278810408469,2.1895,Yes
2013-03-13 08:50:00,2013-03-13 10:40:00,winter,winter/spring,0.4,1.2,0.0,38.72576449216173,0.488,38.23776449216173,0.0,1.09475,No
2013-03-18 20:00:00,2013-03-18 23:50:00,winter,winter/spring,3.6,8.4,0.0,44.87453899331323,4.392,40.48253899331323,0.0,7.663250000000001,No
2013-03-20 09:20:00,2013-03-20 10:20:00,winter,winter/spring,0.4,1.2,0.0,38.72576449216173,0.488,38.23776449216173,0.0,1.09475,No
2013-03-31 22:20:00,2013-03-31 23:20:00,spring,winter/spring,1.5999999999999999,6.0,0.0,40.926065973001094,1.9519999999999997,38.974065973001096,0.0,5.473750000000001,No
2013-04-01 09:20:00,2013-04-01 09:30:00,spring,winter/spring,0.2,1.2,0.0,38.37072454922788,0.244,38.12672454922788,0.0,1.09475,No
2013-04-07 07:10:00,2013-04-07 07:20:00,spring,winter/spring,0.2,1.2,0.0,38.37072454922788,0.244,38.12672454922788,0.0,1.09475,No
2013-04-08 15:20:00,2013-04-08 21:10:00,spring,winter/spring,10.8,13.2,0.0,62.51726927756859,13.176,49.341269277568585,0.0,12.04225,No
2013-04-09 15:10:00,2013-04-10 17:10:00,spring,winter/spring,30.000000000000004,20.4,3.1866,151.35612484362088,36.6,114.75612484362088,0.4935873605947955,18.61075,Yes
2013-04-11 06:00:00,2013-04-13 19:00:00,spring,winter/spring,31.800000000000004,8.4,41.3382,164.43717232149325,38.79600000000001,125.64117232149324,6.403066914498141,7.663250000000001,Yes
2013-04-16 07:00:00,2013-04-16 07:10:00,spring,winter/spring,0.2,1.2,0.0,38.37072454922788,0.244,38.12672454922788,0.0,1.09475,No
2013-04-17 22:20:00,2013-04-18 04:50:00,spring,winter/spring,4.4,7.2,0.0,46.55860935229591,5.368,41.19060935229591,0.0,6.5685,No
2013-04-18 18:50:00,2013-04-18 23:50:00,spring,winter/spring,1.0,2.4,0.0,39.810717055349734,1.22,38.590717055349735,0.0,2.1895,No
2013-04-19 07:50:00,2013-04-19 13:20:00,spring,winter/spring,2.0,3.6,0.0,41.68693834703355,2.44,39.246938347033556,0.0,3.28425,No
2013-04-20 02:40:00,2013-04-20 08:20:00,spring,winter/spring,0.6000000000000001,1.2,0.0,39.084089579240214,0.7320000000000001,38.352089579240214,0.0,1.09475,No
2013-04-24 10:30:00,2013-04-24 16:50:00,spring,winter/spring,13.799999999999999,7.2,0.0,71.77942912713618,16.836,54.943429127136184,0.0,6.5685,No
2013-04-25 16:00:00,2013-04-25 18:20:00,spring,winter/spring,1.4,6.0,0.0,40.55085354483839,1.708,38.84285354483839,0.0,5.473750000000001,No
2013-04-28 17:20:00,2013-04-29 08:20:00,spring,winter/spring,11.2,4.8,0.0,63.67955209079159,13.664,50.01555209079159,0.0,4.379,No
2013-04-29 16:00:00,2013-04-29 21:10:00,spring,winter/spring,1.0,1.2,0.0,39.810717055349734,1.22,38.590717055349735,0.0,1.09475,No
2013-04-30 14:10:00,2013-04-30 14:20:00,spring,winter/spring,0.2,1.2,0.0,38.37072454922788,0.244,38.12672454922788,0.0,1.09475,No
"""


def test_storm_table_on_known_storms(spark):
    known = [dict(zip(STORM_FIELDS.split(), line.split(","))) for line in KNOWN_STORMS.strip().splitlines()]
    assert len(known) == 27
    rows = [
        ("ED-1", i, dt.datetime.fromisoformat(k["start_date"]), dt.datetime.fromisoformat(k["end_date"]), 1.0, *[float(k[c]) for c in ("depth", "peak", "outflow_m3")])
        for i, k in enumerate(known)
    ]
    stats = spark.createDataFrame(
        rows,
        "site string, storm_number int, start_date timestamp_ntz, end_date timestamp_ntz, duration_hours double, "
        "total_precip_depth double, peak_precip_intensity double, total_outflow_m3 double",
    ).withColumns({c: F.lit(None).cast("double") for c in ("antecedent_days", "peak_outflow", "centroid_lag_hours", "peak_lag_hours")})
    sites = spark.createDataFrame([("ED-1", 5781.0, 2578.0, 675.0)], "site string, total_area double, impervious_area double, bmp_area double")
    table = storms.storm_table(
        stats, sites, runoff=volumes.power_volume(1.58, depth=0.02),
        bypass=volumes.linear_volume(depth=1.22), inflow=volumes.net_volume("runoff_m3", "bypass_m3"),
    )
    assert tuple(table.columns) == storms.STORM_COLUMNS
    numbers = ("runoff_m3", "bypass_m3", "inflow_m3", "outflow_mm", "sm_est_peak_inflow")
    for row, k in zip(table.orderBy("storm_number").collect(), known, strict=True):
        assert [row[c] for c in numbers] == pytest.approx([float(k[c]) for c in numbers], rel=1e-9)
        assert [row[c] for c in ("season", "grouped_season", "has_outflow")] == [k[c] for c in ("season", "grouped_season", "has_outflow")]
        assert row["year"] == k["start_date"][:4]


def test_per_site_expressions(spark):
    df = spark.createDataFrame([("x", 2.0), ("y", 2.0), ("z", 2.0)], "site string, d double")
    expr = volumes.by_site({"x": F.col("d") * 2, "y": F.col("d") * 3})
    assert [r[0] for r in df.orderBy("site").select(expr).collect()] == [4.0, 6.0, None]


def test_exclude_storms(spark):
    # --- fixed values: storms, dates and how many are left ---
    start = dt.datetime(2014, 1, 1), dt.datetime(2014, 1, 3)
    rows = [(i, start[0] + dt.timedelta(hours=16 * i), start[1] + dt.timedelta(hours=12 * i)) for i in range(20)]
    df = spark.createDataFrame(rows, "storm_number long, datecol1 timestamp_ntz, datecol2 timestamp_ntz")
    dates = ["2014-01-01", dt.datetime(2014, 1, 2), dt.date(2014, 1, 3), "2014-01-10"]
    assert storms.exclude_storms(df, dates, "datecol1").count() == 14
    assert storms.exclude_storms(df, dates, "datecol2").count() == 16
    assert storms.exclude_storms(df, dates[0], "datecol1").count() == 18
    assert storms.exclude_storms(df, None).count() == 20


def test_exclusion_may_be_kept_to_the_site(spark):
    df = spark.createDataFrame([("a", 1, at(0)), ("b", 1, at(5000))], "site string, storm_number int, start_date timestamp_ntz")
    assert storms.exclude_storms(df, T0.date()).count() == 0
    kept = storms.exclude_storms(df, T0.date(), keys=("site", "storm_number")).collect()
    assert [r["site"] for r in kept] == ["b"]


def test_overrides_replace_with_nulls_too(spark):
    df = spark.createDataFrame([("a", 1, at(0), 1.0, 2.0), ("a", 2, at(5000), 3.0, 4.0)], "site string, storm_number int, start_date timestamp_ntz, x double, y double")
    new = spark.createDataFrame([("a", T0.date(), 9.0, None)], "site string, start_day date, x double, y double")
    got = storms.override_volumes(df, new, ["x", "y"]).orderBy("storm_number").collect()
    assert [(r["x"], r["y"]) for r in got] == [(9.0, None), (3.0, 4.0)]


def test_winsorize(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("a", None), ("b", 7.0)], "site string, v double")
    limits = spark.createDataFrame([("a", 0.2, 0.3), ("b", 0.0, 0.0)], "site string, low double, high double")
    for group_rows in (4, 1000):
        got = storms.winsorize(df, "v", limits, group_rows=group_rows).collect()
        assert sorted(r["v"] for r in got if r["site"] == "a" and r["v"] is not None) == [3, 3, 3, 4, 5, 6, 7, 7, 7, 7]
        assert sum(r["v"] is None for r in got) == 1


def test_rating_curve(spark):
    curve = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 1.0), ("a", 100.0, 10.0), ("b", 5.0, 3.0)], "site string, head_mm double, flow_lps double")
    heads = [("a", -1.0, None), ("a", 0.0, 0.0), ("a", 5.0, 0.5), ("a", 10.0, 1.0), ("a", 55.0, 5.5), ("a", 100.0, 10.0),
             ("a", 100.1, None), ("a", None, None), ("b", 5.0, 3.0), ("c", 5.0, None)]
    df = spark.createDataFrame([(s, i, h) for i, (s, h, _) in enumerate(heads)], "site string, i int, head_mm double")
    rated = hydro.rate_flow(df, curve).orderBy("i").collect()
    assert [r["flow_lps"] for r in rated] == [f if f is None else pytest.approx(f) for _, _, f in heads]


def test_resample_and_fill(spark):
    rows = [("a", at(1), 10.0, 1.0), ("a", at(9), 20.0, 2.0), ("a", at(35), None, 3.0)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, head_mm double, precip_mm double")
    dense = hydro.fill_bins(hydro.resample(df)).orderBy("ts").collect()
    assert [(r["ts"], r["head_mm"], r["precip_mm"]) for r in dense] == [
        (at(0), 15.0, 3.0), (at(10), None, None), (at(20), None, None), (at(30), None, 3.0)
    ]
    assert hydro.resample(df, None).count() == 3


def test_gauge_join_is_outer(spark):
    rain = spark.createDataFrame([("g", at(0), 1.0), ("g", at(10), 2.0)], "site string, ts timestamp_ntz, precip_mm double")
    head = spark.createDataFrame([("a", at(10), 5.0), ("a", at(20), 6.0)], "site string, ts timestamp_ntz, head_mm double")
    gauges = spark.createDataFrame([("a", "g"), ("g", "g")], "site string, raingauge string")
    got = sorted(tuple(r) for r in hydro.join_gauge(head, rain, gauges).filter("site = 'a'").collect())
    assert got == [("a", at(0), 1.0, None), ("a", at(10), 2.0, 5.0), ("a", at(20), None, 6.0)]


def test_samples_match_the_last_storm_within_the_lookback(spark):
    spans = spark.createDataFrame(
        [("a", 1, at(0), at(60)), ("a", 2, at(600), at(5000)), ("b", 1, at(0), at(10))],
        "site string, storm_number int, start_date timestamp_ntz, end_date timestamp_ntz",
    )
    cases = [("a", -1, None), ("a", 0, 1), ("a", 60 + 360, 1), ("a", 60 + 361, None), ("a", 600, 2), ("a", 4000, 2),
             ("a", 5360, 2), ("a", 5361, None), ("b", 5, 1), ("c", 5, None)]
    points = spark.createDataFrame([(s, at(m)) for s, m, _ in cases], "site string, samplestart timestamp_ntz")
    got = {(r["site"], r["samplestart"]): r["storm_number"] for r in samples.match_storms(points, spans).collect()}
    assert got == {(s, at(m)): n for s, m, n in cases}
    # a lookback beyond the dry gap: the later storm wins
    late = samples.match_storms(points.filter("site = 'a'"), spans, lookback_hours=24).collect()
    assert {r["samplestart"]: r["storm_number"] for r in late}[at(600)] == 2 and len(late) == 8


def test_record_labels_cover_dry_bins_inside_storms(spark):
    rows = [("a", 0, 1.0, None), ("a", 10, 0.0, None), ("a", 20, 1.0, None), ("a", 30, 0.0, None)]
    df = record(spark, rows)
    full = storms.label_record(df, storms.storm_stats(storms.label_wet_bins(df))).orderBy("ts").collect()
    assert [r["storm_number"] for r in full] == [1, 1, 1, 0]


def test_results_keep_regular_samples_and_known_parameters(spark):
    s = spark.createDataFrame(
        [("s1", "a", at(0), at(5), 10, "Composite", "REGULAR", False), ("s2", "a", at(0), at(5), 10, "Grab", "QA", False),
         ("s3", "a", at(0), at(5), 10, "Grab", "REGULAR", True)],
        "sample string, site string, samplestart timestamp_ntz, samplestop timestamp_ntz, interval_minutes int, sampletype string, labtype string, ignore boolean",
    )
    r = spark.createDataFrame(
        [(x, p, "CFU/100mL", 0.1, "=", 1.0) for x in ("s1", "s2", "s3") for p in ("Escherichia coli", "junk")],
        "sample string, parameter string, units string, detectionlimit double, qualifier string, concentration double",
    )
    got = samples.wq_results(r, s).collect()
    assert [(g["sample"], g["sampletype"], g["parameter"], g["units"]) for g in got] == [("s1", "composite", "Escherichia coli", "CFU/100 mL")]
    assert samples.wq_results(r, s, only_known=False).count() == 2
    assert samples.unknown_parameters(r).first()["rows"] == 3
    assert [x["sampledate"] for x in samples.sample_dates(samples.regular_samples(s), "composite", "stop").collect()] == [at(5)]
    with pytest.raises(ValueError):
        samples.sample_dates(s, "grab", "middle")


def test_unknown_sites_are_named(spark):
    known = spark.createDataFrame([("a",), ("b",)], "site string")
    samples.require_sites(known, known)
    with pytest.raises(ValueError, match="zz"):
        samples.require_sites(spark.createDataFrame([("a",), ("zz",)], "site string"), known)


@pytest.mark.parametrize("minutes", [7, 10, 25, 60])
def test_dense_bins_keep_every_reading(spark, minutes):
    """Also at periods that do not divide a day, and before 1970."""
    times = [dt.datetime(1969, 12, 31, 23, 50), dt.datetime(1970, 1, 1, 0, 3), dt.datetime(1970, 1, 3, 5, 1)]
    rows = [("a", t, 1.0, float(k)) for k, t in enumerate(times)] + [("b", dt.datetime(2024, 2, 29, 12, 1), None, 8.0)]
    rows += [("b", dt.datetime(2024, 2, 29, 12, 2) + dt.timedelta(minutes=13 * k), 2.0, 1.0) for k in range(300)]
    readings = spark.createDataFrame(rows, "site string, ts timestamp_ntz, head_mm double, precip_mm double")
    dense = hydro.fill_bins(hydro.resample(readings, minutes), minutes, chunk=50)
    got = {r["site"]: r for r in dense.groupBy("site").agg(
        F.sum("precip_mm").alias("rain"), F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    ).collect()}
    assert (got["a"]["rain"], got["b"]["rain"]) == (3.0, 308.0)
    for r in got.values():
        assert r["n"] == (r["last"] - r["first"]) / dt.timedelta(minutes=minutes) + 1


def test_raw_gauge_join_merges_readings(spark):
    readings = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1), 5.0, 1.0), ("b", dt.datetime(2024, 1, 1), 9.0, 7.0)],
        "site string, ts timestamp_ntz, level_mm double, precip_mm double",
    )
    sites = spark.createDataFrame([("a", 1, "a"), ("b", 2, "a")], "site string, weir_height_mm int, raingauge string")
    got = {(r["site"], r["head_mm"], r["precip_mm"]) for r in hydro.gauged_record(readings, sites, None).collect()}
    assert got == {("a", 4.0, 1.0), ("b", 7.0, 1.0)}


def test_all_unknown_sites_are_counted(spark):
    wanted = spark.createDataFrame([(f"x{k:02}",) for k in range(33)], "site string")
    with pytest.raises(ValueError, match="33 unknown sites: .*x19.* and 13 more"):
        samples.require_sites(wanted, spark.createDataFrame([("a",)], "site string"))
    samples.require_sites(wanted, wanted)


def test_storm_lists_are_sorted(spark):
    storm_rows = spark.createDataFrame([("b", 2), ("a", 10), ("a", 9), ("b", 1), ("c", 1)], "site string, storm_number int")
    matched = spark.createDataFrame([("b", 2, "composite"), ("b", 1, "composite"), ("a", 10, "composite")], "site string, storm_number int, sampletype string")
    assert [tuple(r) for r in samples.storms_with_samples(storm_rows, matched).collect()] == [("a", 10), ("b", 1), ("b", 2)]
    assert [tuple(r) for r in samples.storms_without_samples(storm_rows, matched).collect()] == [("a", 9), ("c", 1)]


def test_repeated_intervals_are_not_broadcast_by_their_size_before(spark):
    """A small table of curves or storms may be large once it is repeated per grid cell."""
    spans = spark.range(10).selectExpr("'a' AS site", "id * 10 AS low", "id * 10 + 5 AS high")
    points = spark.range(100).selectExpr("'a' AS site", "id AS x")
    inside = F.expr("x >= low AND x < high")
    found = join_on_grid(points, spans, ["site"], F.col("x"), F.col("low"), F.col("high"), inside)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert found.where("low IS NOT NULL").count() == 50 and found.count() == 100
