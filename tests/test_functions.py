"""Expressions, on inline frames."""

import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from freshet.functions import bins, clock, numbers, options, pollutants, volumes


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_seasons_and_year(spark):
    days = ["2012-02-02", "2008-04-01", "2013-07-21", "2001-11-24", "2013-03-20", "2013-03-31", "2012-12-22", "2012-12-21"]
    df = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("CAST(d AS TIMESTAMP_NTZ) AS ts")
    assert column(df, clock.season("ts")) == ["winter", "spring", "summer", "autumn", "winter", "spring", "winter", "autumn"]
    assert column(df, clock.grouped_season("ts"))[:4] == ["winter/spring", "winter/spring", "summer/autumn", "summer/autumn"]
    assert column(df, clock.year_label("ts"))[0] == "2012"


def test_durations_do_not_depend_on_the_time_zone(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-03-10 01:30:00.25' AS a, TIMESTAMP_NTZ'2024-03-10 03:30:00.75' AS b"
    )
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:00-03:00 does not exist there
        hours, micros = df.select(clock.hours_between("a", "b"), clock.epoch_micros("a")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert hours == pytest.approx(2 + 0.5 / 3600)
    epoch = dt.datetime(2024, 3, 10, 1, 30, 0, 250000) - dt.datetime(1970, 1, 1)
    assert micros == epoch // dt.timedelta(microseconds=1)


def test_bin_labels():
    assert bins.bin_labels([0, 5, 10, 15, math.inf], "feet") == ["<5 feet", "5 - 10 feet", "10 - 15 feet", ">15 feet"]


def test_classify_storms(spark):
    df = spark.createDataFrame([(2, 0), (8, 10), (14, 20), (20, 30), (26, 40), (0, 1), (5, 1)], "A long, B long")
    out = bins.classify_storms(df, "A", "C").orderBy("B", "A").collect()
    got = {r["A"]: r["C"] for r in out}
    assert got == {2: "<5 mm", 8: "5 - 10 mm", 14: "10 - 15 mm", 20: "15 - 20 mm", 26: ">25 mm", 0: None, 5: "<5 mm"}


def test_ratios(spark):
    df = spark.createDataFrame([(75.0, 50.0), (50.0, 50.0), (25.0, 10.0), (10.0, 20.0), (0.0, 1.0)], "A double, B double")
    got = column(df, numbers.pct_reduction("A", "B"))
    assert got[:4] == pytest.approx([100 / 3, 0, 60, -100]) and got[4] is None


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.01, 0.07, 0.2, 0.5, 0.8, 0.9249, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double")
    got = column(df, numbers.normal_quantile("p"))
    assert got[: len(ps)] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-14)
    assert got[len(ps):] == [None, None, None]


@pytest.mark.parametrize(
    "value,text",
    [
        (0.12, "0.120"), (786.0, "786"), (8.6, "8.60"), (1350.0, "1,350"), (0.052, "0.0520"), (0.002, "0.00200"),
        (7239.036, "7,240"), (40.6420164, "40.6"), (0.00827318, "0.00827"), (5687.814, "5,690"), (0.0, "0.0"),
        (-1350.4, "-1,350"), (4653665999.9999, "4.65e+09"), (123456.0, "123,000"), (None, None), (1000.0, "1,000"),
    ],
)
def test_sig_figs(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert column(df, numbers.sig_figs("x", 3)) == [text]


def test_with_units(spark):
    df = spark.createDataFrame([(0.12, "mg/L"), (None, "mg/L")], "x double, u string")
    assert column(df, numbers.with_units("x", "u")) == ["0.120 mg/L", "--"]


def test_pollutant_lookups(spark):
    assert pollutants.lookup("landuse_name", "Copper", "parameter") == "Copper (Cu)"
    with pytest.raises(ValueError):
        pollutants.lookup("group", "A", "parameter")
    with pytest.raises(LookupError):
        pollutants.lookup("parameter", "nothing", "load_units")
    assert pollutants.names(headline_only=True) == [
        "Cadmium (Cd)", "Copper (Cu)", "Iron (Fe)", "Lead (Pb)", "Nickel (Ni)", "Zinc (Zn)",
        "Nitrate (N)", "Nitrate + Nitrite", "Total Phosphorus", "Total Suspended Solids",
    ]
    df = spark.createDataFrame([("Copper (Cu)",), ("Escherichia coli",), ("Nitrate (N)",), ("other",)], "parameter string")
    assert column(df, pollutants.attribute("parameter", "load_factor")) == [1e-3, 1e4, 1.0, None]
    assert column(df, pollutants.attribute("parameter", "load_units")) == ["g", "CFU", "g", None]
    assert pollutants.influent_template(spark).count() == 64


def test_units_are_corrected(spark):
    df = spark.createDataFrame([("mg/L",), ("ft",), ("CFU/100mL",), ("CFU/100 mL",), (None,)], "UOM string")
    fixed = pollutants.fix_units(df, pollutants.OWN_BACTERIA_SPELLINGS, "UOM")
    assert column(fixed, "UOM") == ["mg/L", "ft", "CFU/100 mL", "CFU/100 mL", None]


def test_simple_method(spark):
    df = spark.createDataFrame([(10.0, 5781.0, 2578.0, 675.0)], "d double, t double, i double, b double")
    assert column(df, volumes.simple_method("d", "t", "i", "b")) == pytest.approx([32842.5])
    assert column(df, volumes.outflow_depth(F.lit(51.7074), "t", "b")) == pytest.approx([8.0092007], rel=1e-6)


def test_option_checks():
    assert options.result_column("concenTRATION") == ("concentration", "units")
    assert options.result_column("load_outflow") == ("load_outflow", "load_units")
    assert options.time_group("seASon") == "season" and options.time_group(None) is None
    assert options.sample_type("comPOSite") == "composite"
    for check in (options.result_column, options.time_group, options.sample_type):
        with pytest.raises(ValueError):
            check("junk")
