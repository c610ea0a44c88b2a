"""Sources, sinks, streams and the query registry."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from freshet.operators import lineage, storms
from freshet.sources import sinks, tables
from freshet.streaming import hydro as stream
from workload.queries import ORACLES, QUERIES

T0 = dt.datetime(2024, 1, 1)


def test_tidy_csv_round_trip(spark, tmp_path):
    ddl = tables.SCHEMAS["rating_curves"]
    df = spark.createDataFrame([("a", 1.5, None), ("b", 2.0, 3.0)], ddl)
    sinks.write_tidy(df, str(tmp_path / "curve"), "csv")
    back = tables.read_tidy_csv(spark, str(tmp_path / "curve"), ddl)
    assert sorted(map(tuple, back.collect())) == [("a", 1.5, None), ("b", 2.0, 3.0)]
    assert back.schema == df.schema


def test_tables_are_read_with_their_schema_and_without_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), 1.0)], tables.SCHEMAS["rating_curves"])
    sinks.write_tidy(df, str(tmp_path / "p"))
    assert tables.read_table(spark, str(tmp_path / "p"), "rating_curves").collect()[0]["head_mm"] is None
    csv = tmp_path / "hydro.csv"
    csv.write_text("site,ts,level_mm,precip_mm,flow_lps\na,2024-01-01 00:10:00,1.5,,2\n")
    row = tables.read_table(spark, str(csv), "hydro", "csv").first()
    assert (row["ts"], row["precip_mm"], row["flow_lps"]) == (T0 + dt.timedelta(minutes=10), None, 2.0)


def test_reports_are_partitioned_by_grouping(spark, tmp_path):
    df = spark.createDataFrame([("Overall", 1), ("By Year", 2)], "grouping string, x int")
    sinks.write_reports(df, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["grouping=By Year", "grouping=Overall"]


def test_catalog_tables_are_read_by_sql(spark):
    spark.createDataFrame([("a", 1.0, float("nan"))], tables.SCHEMAS["rating_curves"]).createOrReplaceTempView("curves")
    rows = tables.conform(tables.read_sql(spark, "SELECT head_mm, flow_lps, site FROM curves"), "rating_curves").collect()
    assert [tuple(r) for r in rows] == [("a", 1.0, None)]


def test_names_are_normalized(spark):
    assert tables.normalize_names(spark.createDataFrame([(1,)], "`Total Outflow` int")).columns == ["total_outflow"]


def test_cut_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert lineage.cut(spark.range(3)).count() == 3
    assert folder in spark.sparkContext.getCheckpointDir()


def test_streamed_storms_equal_the_batch_ones(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(minutes=m, seconds=7), 1.0, 2.0) for m in (0, 4, 12, 30, 500, 505, 1200, 9000)]
    schema = "site string, ts timestamp, head_mm double, precip_mm double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        stream.resample_stream(live, late="0 seconds").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c1")).option("path", str(tmp_path / "bins")).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    bins = spark.read.parquet(str(tmp_path / "bins"))
    assert bins.filter(F.col("ts") == T0).first()["precip_mm"] == 4.0
    binned = spark.readStream.schema(bins.schema).parquet(str(tmp_path / "bins"))
    query = (
        stream.storm_sessions(binned, late="0 seconds").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c2")).option("path", str(tmp_path / "storms")).outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    closed = {(r["start_date"], r["end_date"], r["total_precip_depth"]) for r in spark.read.parquet(str(tmp_path / "storms")).collect()}
    batch = storms.storm_stats(storms.label_wet_bins(bins.select("site", "ts", "precip_mm"))).collect()
    known = {(r["start_date"], r["end_date"], r["total_precip_depth"]) for r in batch}
    assert closed <= known and len(closed) >= len(known) - 1  # the last storm may still be open


def test_registry_is_complete():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(queries)
    assert len(QUERIES) >= 80 and set(ORACLES) == set(QUERIES)
    assert not [n for n in QUERIES if re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", ["storm_table", "load_totals", "wq_summary", "storm_sample_asof", "sample_tables"])
def test_queries_run(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
