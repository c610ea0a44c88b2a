"""Schemas and readers of the monitoring tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "sites": "site string, sitename string, total_area double, impervious_area double, "
    "bmp_area double, weir_height_mm int",
    "samples": "sample string, site string, samplestart timestamp_ntz, samplestop timestamp_ntz, "
    "interval_minutes int, sampletype string, labtype string, labworkorder string, "
    "collectiondate timestamp_ntz, samplingnotes string, ignore boolean",
    "results": "sample string, parameter string, units string, detectionlimit double, "
    "qualifier string, concentration double",
    "hydro": "site string, ts timestamp_ntz, level_mm double, precip_mm double, flow_lps double",
    "rating_curves": "site string, head_mm double, flow_lps double",
    "wq_standards": "parameter string, units string, lower_limit double, upper_limit double",
    "storms": "site string, storm_number int, year string, season string, grouped_season string, "
    "antecedent_days double, start_date timestamp_ntz, end_date timestamp_ntz, duration_hours double, "
    "peak_precip_intensity double, total_precip_depth double, runoff_m3 double, bypass_m3 double, "
    "inflow_m3 double, outflow_m3 double, outflow_mm double, peak_outflow double, "
    "centroid_lag_hours double, peak_lag_hours double, has_outflow string, sm_est_peak_inflow double",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet", **options) -> DataFrame:
    """A monitoring table from files (parquet, orc, csv, json) under ``path``.

    The schema is given, never inferred, and NaN becomes null. Columns and
    filters used later are pushed to the scan.
    """
    want = schema(table)
    reader = spark.read.schema(want).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    return nan_to_null(reader.format(fmt).load(path))


def read_jdbc(spark: SparkSession, url: str, table: str, dbtable: str | None = None, **options) -> DataFrame:
    """A monitoring table from a database; filters are pushed to the server.

    Give ``partitionColumn, lowerBound, upperBound, numPartitions`` to read
    in parallel.
    """
    df = spark.read.format("jdbc").options(url=url, dbtable=dbtable or table, **options).load()
    return conform(df, table)


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    """Any query over the tables of the session catalog."""
    return spark.sql(query)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast a frame to the schema of a monitoring table."""
    return nan_to_null(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table).fields]))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers as null: NaN would sort above every value."""
    return df.select(
        *[
            F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_tidy_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A tidy table from CSV with a given schema, dates typed by it."""
    return spark.read.schema(ddl).option("header", True).csv(path)


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores for spaces."""
    return df.withColumnsRenamed({c: c.lower().replace(" ", "_") for c in df.columns})
