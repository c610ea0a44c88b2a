import datetime as dt
import os
import random

from pyspark.sql import functions as F

from freshet.operators import refresh, storms

T0 = dt.datetime(2014, 1, 1)
BINS = "site string, ts timestamp_ntz, precip_mm double, flow_lps double"


def random_bins(rng, n, sites="abc", days=150):
    """Showers here and there: runs of wet bins, some dry."""
    rows = []
    for _ in range(n):
        site, at = rng.choice(sites), rng.randrange(days * 144)
        for k in range(rng.randint(1, 12)):
            rows.append((site, T0 + dt.timedelta(minutes=10 * (at + k * rng.choice([1, 1, 30]))), rng.choice([0.0, 1.0, 2.5, None]), rng.choice([None, 0.5, 3.0])))
    return rows


def same_as_rebuilt(spark, folder, latest):
    rows = [(site, ts, *v) for (site, ts), v in latest.items()]
    whole = storms.storm_stats(storms.label_wet_bins(spark.createDataFrame(rows, BINS)))
    names = [c for c in whole.columns if c in refresh.stored_storms(spark, folder).columns]
    assert len(names) == len(whole.columns)

    def key(r):
        return tuple(round(v, 7) if isinstance(v, float) else v for v in r)

    found = sorted(map(repr, map(key, refresh.stored_storms(spark, folder).select(*names).collect())))
    assert found == sorted(map(repr, map(key, whole.select(*names).collect()))) and found
    assert refresh.stored_bins(spark, folder).count() == len(latest)


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_random_inserts_equal_a_rebuild(spark, tmp_path):
    rng, folder, latest = random.Random(6), str(tmp_path / "site"), {}
    for n in (60, 25, 3):
        rows = random_bins(rng, n)
        rows += [(site, ts, 0.0, None) for site, ts in rng.sample(sorted(latest), min(len(latest), 30))]  # taken back
        rows = list({r[:2]: r for r in rows}.values())
        refresh.insert_bins(spark, folder, spark.createDataFrame(rows, BINS).repartition(3))
        latest |= {r[:2]: r[2:] for r in rows}
        same_as_rebuilt(spark, folder, latest)


def test_a_new_bin_joins_two_storms_over_a_month_and_leaves_the_rest(spark, tmp_path):
    folder, hour = str(tmp_path / "s"), dt.timedelta(hours=1)
    end = dt.datetime(2014, 2, 1)
    first = {("a", T0): (1.0, 1.0), ("a", end - 5 * hour): (1.0, 1.0), ("a", end + 4 * hour): (2.0, 1.0), ("a", end + 900 * hour): (1.0, None), ("b", T0): (4.0, None)}
    refresh.insert_bins(spark, folder, spark.createDataFrame([(*k, *v) for k, v in first.items()], BINS))
    before = files(f"{folder}/storms")
    joining = {("a", end): (9.0, None)}
    refresh.insert_bins(spark, folder, spark.createDataFrame([(*k, *v) for k, v in joining.items()], BINS))
    same_as_rebuilt(spark, folder, first | joining)
    found = refresh.stored_storms(spark, folder).where("site = 'a'").orderBy("storm_number").collect()
    assert [(r.storm_number, r.total_precip_depth) for r in found] == [(1, 1.0), (2, 12.0), (3, 1.0)]
    after = files(f"{folder}/storms")
    kept = {f for f in before if after.get(f) == before[f]}
    assert any("month=24170" in f for f in kept)  # March is not written again
    # the storm of February went into January's, whose partition of February is now empty
    assert refresh.stored_storms(spark, folder).where(F.col("start_date") >= end).count() == 1


def test_inserting_again_nothing_and_only_dry_bins(spark, tmp_path):
    folder = str(tmp_path / "s")
    dry = spark.createDataFrame([("a", T0, 0.0, None)], BINS)
    refresh.insert_bins(spark, folder, dry)
    rows = random_bins(random.Random(1), 10, "a", 20) + [(None, T0, 1.0, 1.0), ("a", None, 1.0, 1.0)]
    for _ in range(2):  # an insert that is repeated
        refresh.insert_bins(spark, folder, spark.createDataFrame(rows, BINS).dropDuplicates(["site", "ts"]).orderBy("site", "ts"))
    once = refresh.stored_storms(spark, folder).collect()
    refresh.insert_bins(spark, folder, spark.createDataFrame([], BINS))
    assert sorted(map(repr, once)) == sorted(map(repr, refresh.stored_storms(spark, folder).collect())) and once
