"""A storm table that is kept up to date: new bins change the storms near them, and nothing else is read or written.

A folder holds the bins of a record and its storms, both in partitions of
months and groups of sites. A storm is known by its start; its number and the
dry spell before it follow from the storms before it, so they are made when
the table is read, from one row per storm, and a storm that comes in between
moves all later numbers without a write.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.functions.clock import day_index, days_between, month_index, plus_minutes
from freshet.operators.intervals import join_on_grid
from freshet.operators.lineage import cut, marked
from freshet.operators.storms import is_wet, label_wet_bins, storm_stats, with_flow_columns

#: Groups of sites; a partition is a month of one group.
SITE_GROUPS = 16
_BIN = "site string, ts timestamp_ntz, precip_mm double, inflow_lps double, flow_lps double, batch string, written timestamp"
_PLACE = ["month", "site_group"]


def _site_group() -> F.Column:
    return F.pmod(F.xxhash64("site"), F.lit(SITE_GROUPS)).cast("int")


def _write(df: DataFrame, path: str, mode: str) -> None:
    # one file per partition and batch
    writer = df.repartition(*_PLACE).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*_PLACE).parquet(path)


def stored_bins(spark: SparkSession, folder: str) -> DataFrame:
    """The bins as last inserted: a bin that came again has its later values."""
    return _latest(_read_bins(spark, folder))


def _latest(bins: DataFrame) -> DataFrame:
    values = F.struct("precip_mm", "inflow_lps", "flow_lps")
    last = bins.groupBy("site", "ts").agg(F.max_by(values, F.struct("written", "batch")).alias("v"))
    return last.select("site", "ts", "v.*")


def stored_storms(spark: SparkSession, folder: str) -> DataFrame:
    """The storm statistics of the folder, as ``storm_stats`` gives them for its whole record."""
    storms = spark.read.parquet(f"{folder}/storms").drop(*_PLACE).where("site IS NOT NULL")
    in_site = Window.partitionBy("site").orderBy("start_date")
    return (
        storms.withColumn("storm_number", F.row_number().over(in_site))
        .withColumn("_prev_end", F.lag("end_date").over(in_site))
        .withColumn("antecedent_days", days_between("_prev_end", "start_date"))
        .drop("_prev_end")
    )


def insert_bins(spark: SparkSession, folder: str, bins: DataFrame, interevent_hours: float = 6, period_minutes: int = 10) -> None:
    """Add bins to the record in ``folder``, or replace bins with the same site and start, and refresh the storms.

    A storm can change only if a new bin lies in it or within the interevent
    time of it. Those storms are taken out; their bins and the new ones are
    labelled anew, and the partitions they start in are written again, all
    others stay as they are. A bin may be dry, to take a wet one back. A
    broken-off insert can be repeated: bins are written first, storms last.
    """
    batch = uuid.uuid4().hex
    columns = with_flow_columns(bins).select("site", "ts", "precip_mm", "inflow_lps", "flow_lps")
    placed = {"batch": F.lit(batch), "written": F.current_timestamp(), "month": month_index("ts"), "site_group": _site_group()}
    new = cut(columns.na.drop(subset=["site", "ts"]).dropDuplicates(["site", "ts"]).withColumns(placed))
    _write(new, f"{folder}/bins", "append")

    reach = interevent_hours * 60 + period_minutes
    of_month = new.groupBy("site", "month")
    spans = cut(of_month.agg(plus_minutes("min(ts)", -reach).alias("_from"), plus_minutes("max(ts)", reach + period_minutes).alias("_to")))
    old, touched = _stored(spark, f"{folder}/storms"), new.drop(*_PLACE)
    if old is not None:
        near = F.sequence(month_index(_shifted("start_date", -reach - period_minutes)), month_index(_shifted("end_date", reach)))
        candidates = old.drop("month").withColumn("month", F.explode(near)).join(marked(spans), ["site", "month"])
        changed = candidates.where((F.col("end_date") > F.col("_from")) & (F.col("start_date") < F.col("_to")))
        changed = cut(changed.select("site", "site_group", "start_date", "end_date").distinct())
        months = changed.select("site_group", F.explode(F.sequence(month_index("start_date"), month_index("end_date"))).alias("month"))
        stored = _read_bins(spark, folder).join(marked(cut(months.distinct())), _PLACE, "left_semi")
        spots = changed.select("site", F.col("start_date").alias("_start"), F.col("end_date").alias("_end"))
        inside = (F.col("ts") >= F.col("_start")) & (F.col("ts") < F.col("_end"))
        held = join_on_grid(stored, spots, ["site"], day_index("ts"), day_index("_start"), day_index("_end"), inside)
        touched = touched.unionByName(held.where(F.col("_start").isNotNull()).select(*touched.columns))
    wet = _latest(touched).filter(is_wet())
    storms = storm_stats(label_wet_bins(wet, interevent_hours, period_minutes), period_minutes).drop("storm_number", "antecedent_days")
    storms = storms.withColumns({"month": month_index("start_date"), "site_group": _site_group()})
    if old is not None:
        # computed before the partitions that it reads are replaced; one that loses all its storms gets a row without a site
        storms = cut(storms)
        homes = cut(storms.select(*_PLACE).union(changed.select(month_index("start_date"), "site_group")).distinct())
        kept = old.join(marked(homes), _PLACE, "left_semi").join(changed.select("site", "start_date"), ["site", "start_date"], "left_anti")
        storms = cut(storms.unionByName(kept.where("site IS NOT NULL")))
        emptied = homes.join(storms.select(*_PLACE).distinct(), _PLACE, "left_anti")
        storms = storms.unionByName(emptied, allowMissingColumns=True)
    _write(storms, f"{folder}/storms", "overwrite")


def _shifted(ts: str, minutes: float) -> str:
    return f"({ts} + make_dt_interval(0, 0, 0, CAST({float(minutes) * 60} AS DECIMAL(18, 6))))"


def _read_bins(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{_BIN}, month int, site_group int").parquet(f"{folder}/bins")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing there yet, or no storm so far
            return None
        raise
