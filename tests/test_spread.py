"""Ranks and running values must not depend on how groups are cut."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from freshet.functions import numbers
from freshet.operators import censored, spread
from freshet.operators.spread import CELL, cut_groups, numbered, quantiles, ranked_values


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most rows, one has a single row, one holds one value often."""
    rng = random.Random(5)
    rows = [("hot", round(rng.lognormvariate(0, 1.5), 3), rng.random() < 0.3) for _ in range(3000)]
    rows += [("cold", round(rng.random(), 2), rng.random() < 0.3) for _ in range(40)]
    rows += [("single", 4.0, False)] + [("same", 2.5, i % 3 == 0) for i in range(60)]
    rows += [("none", None, False)] * 3 + [(None, 1.0, False)] * 3
    return spark.createDataFrame(rows, "g string, v double, nd boolean").withColumn(
        "q", F.when(F.col("nd"), "<").otherwise("=")
    )


def as_set(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_a_large_group_is_cut_evenly(hot):
    distinct = hot.na.drop(subset=["g", "v"]).select("g", "v").distinct()
    cells = cut_groups(distinct, ["g"], "v", group_rows=200, slots=32).groupBy("g", CELL).count().collect()
    sizes = [r["count"] for r in cells if r["g"] == "hot"]
    assert len(sizes) > 25 and max(sizes) < sum(sizes) / 5
    assert [r[CELL] for r in cells if r["g"] == "cold"] == [-1]
    assert CELL not in cut_groups(distinct, ["g"], "v").columns


def test_ranks_match_brute_force(hot):
    rows = sorted((r["g"], r["v"]) for r in hot.collect() if r["g"] and r["v"] is not None)
    for group_rows in (100, 10**6):
        got = {
            (r["g"], r["v"]): (r["n"], r["n_below"], r["n_total"])
            for r in ranked_values(hot, ["g"], "v", group_rows=group_rows).collect()
        }
        want = {}
        for g in {g for g, _ in rows}:
            values = [v for k, v in rows if k == g]
            for v in set(values):
                want[g, v] = (values.count(v), sum(x < v for x in values), len(values))
        assert got == want


def test_quantiles_match_the_builtin(hot):
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    want = hot.filter("g IS NOT NULL AND v IS NOT NULL").groupBy("g").agg(
        *[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()]
    )
    for group_rows in (100, 10**6):
        assert as_set(quantiles(hot, ["g"], "v", probs, group_rows)) == as_set(want)


def test_ros_does_not_depend_on_the_cut(hot):
    whole = as_set(censored.ros_values(hot, ["g"], "v", "q").select("g", "v", "censored", "position", "ros_v"))
    cut = as_set(censored.ros_values(hot, ["g"], "v", "q", group_rows=100).select("g", "v", "censored", "position", "ros_v"))
    assert whole == cut and len(whole) == 3101


def exceedance_positions(rows):
    """Plotting positions by the published recursion, one observation at a time."""
    limits = sorted({v for v, nd in rows if nd})
    n = len(limits)
    a = [sum(1 for v, nd in rows if not nd and v >= limits[j] and (j + 1 == n or v < limits[j + 1])) for j in range(n)]
    b = [sum(1 for v, nd in rows if (nd and v <= limits[j]) or (not nd and v < limits[j])) for j in range(n)]
    pe = [0.0] * (n + 1)
    for j in reversed(range(n)):
        pe[j] = pe[j + 1] + a[j] / (a[j] + b[j]) * (1 - pe[j + 1])
    out = []
    brackets = {}
    for v, nd in sorted(rows):
        j = max((k for k in range(n) if limits[k] <= v), default=-1)
        if nd:
            rank = brackets[j, True] = brackets.get((j, True), 0) + 1
            c = sum(1 for x, y in rows if y and x == v)
            out.append((v, True, (1 - pe[j]) * rank / (c + 1)))
        else:
            rank = brackets[j, False] = brackets.get((j, False), 0) + 1
            low = 1 - pe[j] if j >= 0 else 0.0
            high = 1 - pe[j + 1]
            count = a[j] if j >= 0 else sum(1 for x, y in rows if not y and (not limits or x < limits[0]))
            out.append((v, False, low + (high - low) * rank / (count + 1)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_positions_match_the_recursion(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        limit = rng.choice([0.5, 1.0, 2.0])
        x = round(rng.lognormvariate(0.4, 0.9), 1) + 0.1
        rows.append((limit, True) if x < limit else (x, False))
    df = spark.createDataFrame([("a", v, "<" if nd else "=") for v, nd in rows], "g string, v double, q string")
    got = sorted((r["v"], r["censored"], r["position"]) for r in censored.ros_positions(df, ["g"], "v", "q", group_rows=5).collect())
    want = exceedance_positions(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_ros_of_a_published_data_set(spark):
    """Helsel & Cohn's worked example: imputed values stay below their limits' tail."""
    data = [(1, True)] * 3 + [(10, True)] * 3 + [(3, False), (7, False), (9, False), (12, False), (15, False), (20, False), (27, False), (33, False), (50, False)]
    df = spark.createDataFrame([("a", float(v), "<" if nd else "=") for v, nd in data], "g string, v double, q string")
    rows = censored.ros_values(df, ["g"], "v", "q").orderBy("position").collect()
    assert all(r["ros_v"] == r["v"] for r in rows if not r["censored"])
    estimates = [r["ros_v"] for r in rows if r["censored"]]
    assert estimates == sorted(estimates) and 0 < estimates[0] and estimates[-1] < 10


def test_ros_guards(spark):
    few = [("few", 1.0, "="), ("few", 2.0, "<")]
    most = [("most", 3.0, "="), ("most", 5.0, "=")] + [("most", 2.0, "<")] * 9
    clean = [("clean", 1.0, "="), ("clean", 4.0, "=")]
    df = spark.createDataFrame(few + most + clean, "g string, v double, q string")
    got = {(r["g"], r["v"]): r["ros_v"] for r in censored.ros_values(df, ["g"], "v", "q").collect()}
    assert got["few", 2.0] == 1.0 and got["most", 2.0] == 1.0
    assert got["clean", 1.0] == 1.0 and got["clean", 4.0] == 4.0


def test_median_bounds_bracket_the_median(hot):
    for bounds in ("order", "notch"):
        for r in censored.median_bounds(hot, ["g"], "v", "q", bounds=bounds, group_rows=200).collect():
            assert r["lower"] <= r["median"] <= r["upper"]


def test_bootstrap_bounds(hot):
    """One rule for groups of every size, whatever the size of a cell; close to actual resampling."""
    boot = {r["g"]: r for r in censored.bootstrap_median_bounds(hot, ["g"], "v", "q").collect()}
    cut = {r["g"]: r for r in censored.bootstrap_median_bounds(hot, ["g"], "v", "q", group_rows=100).collect()}
    for g, r in boot.items():
        assert r["lower"] <= r["median"] <= r["upper"]
        assert [cut[g][c] for c in ("lower", "median", "upper")] == pytest.approx([r[c] for c in ("lower", "median", "upper")])
    assert boot["single"]["lower"] == boot["single"]["upper"] == 4.0
    rng = random.Random(1)
    for n in (1, 2, 9, 60, 61, 301):
        medians = sorted(statistics.median(rng.randrange(n) for _ in range(n)) for _ in range(1500))
        low, high = numbers.bootstrap_rank(n, (n + 1) // 2, 0.025), numbers.bootstrap_rank(n, n // 2 + 1, 0.975)
        assert abs(low - medians[37]) <= 2 + n / 60 and abs(high - medians[1462]) <= 2 + n / 60
    exact = next(k for k in range(1, 62) if sum(math.comb(61, j) * (k / 61) ** j * (1 - k / 61) ** (61 - j) for j in range(31, 62)) >= 0.025)
    assert numbers.bootstrap_rank(61, 31, 0.025) == exact - 1
    big = numbers.bootstrap_rank(10**8, 50_000_000, 0.025)
    assert big == pytest.approx(10**8 / 2 - 1.959964 * 10**4 / 2, abs=30)


def test_equal_values_are_numbered_in_several_tasks(spark):
    df = spark.createDataFrame([("a", 1.0, 25_000), ("a", 2.0, 1), ("b", 1.0, 3)], "g string, v double, n long")
    each = numbered(df, ["g", "v"], "n", "i", block=1000).withColumn("task", F.spark_partition_id())
    assert {(r["g"], r["v"]): (r["n"], r["least"], r["most"], r["distinct"]) for r in each.groupBy("g", "v").agg(
        F.count("*").alias("n"), F.min("i").alias("least"), F.max("i").alias("most"), F.countDistinct("i").alias("distinct")
    ).collect()} == {("a", 1.0): (25_000, 1, 25_000, 25_000), ("a", 2.0): (1, 1, 1, 1), ("b", 1.0): (3, 1, 3, 3)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert each.where("v = 1").select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_first_per_key(spark):
    df = spark.createDataFrame(
        [("a", 2, None, "x"), ("a", 1, None, "y"), ("a", 3, 5.0, "z"), (None, 1, 1.0, "w")], "k string, i int, v double, s string"
    )
    assert [tuple(r) for r in censored.first_per_key(df, ["k"], ["i"]).select("k", "v", "s").collect()] == [("a", 5.0, "y")]


def test_cells_stay_as_large_when_rows_quadruple(spark):
    largest = {}
    for n in (3000, 12_000):
        values = spark.range(n).select(F.lit("g").alias("g"), (F.xxhash64("id") / 1e9).alias("v"))
        cells = cut_groups(values, ["g"], "v", group_rows=200, slots=4).groupBy(CELL).count().collect()
        largest[n] = max(r["count"] for r in cells)
        assert len(cells) >= n // 200
    assert largest[12_000] < 1.7 * largest[3000]


def test_only_values_near_the_ranks_are_kept(spark, monkeypatch):
    """Exact percentiles from a few hundredths of the rows, ties, NaN and groups without values included."""
    rng = random.Random(7)
    rows = [("wide", rng.lognormvariate(0, 2)) for _ in range(6000)] + [("ties", float(rng.randrange(3))) for _ in range(900)]
    rows += [("few", 1.0), ("few", 2.0), ("none", None), (None, 5.0)] + [("nan", math.nan if k % 3 == 0 else k / 7) for k in range(600)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"low": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "high": 1.0}
    kept = []
    monkeypatch.setattr(spread, "cut", lambda df, real=spread.cut: kept.append(real(df)) or kept[-1])
    groups, ranked = spread.near_ranks(df, ["g"], "v", [spread.rank_of(p) for p in probs.values()], {"most": F.max("v")}, band_rows=100)
    found = ranked.groupBy("g").agg(*[spread.interpolated(p, "v").alias(n) for n, p in probs.items()])
    want = df.na.drop(subset=["g"]).where("v IS NOT NULL").groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()])
    assert repr(as_set(found)) == repr(as_set(want))
    assert {r.g: r.n_total for r in groups.collect()} == {"wide": 6000, "ties": 900, "few": 2, "none": 0, "nan": 600}
    assert kept[2].where("g = 'wide'").count() < 600 and kept[2].where("g = 'wide'").agg(F.sum("n")).first()[0] == 6000
    _, whole = spread.near_ranks(df, [], "v", [spread.rank_of(0.5)], band_rows=100)
    assert whole.agg(spread.interpolated(0.5, "v")).first()[0] == df.where("v IS NOT NULL").agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_cells_are_found_by_a_binary_search(spark):
    """Cells follow each other in the order of the values; no value is held against all cuts of its group."""
    values = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") / 1e9).alias("v"))
    for slots in (1, 3, 37):
        placed = cut_groups(values, ["g"], "v", group_rows=200, slots=slots)
        rows = sorted((r.g, r.v, r[CELL]) for r in placed.collect())
        assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])
        for g in (0, 1):
            cells = {c for k, _, c in rows if k == g}
            assert min(cells) == 0 and cells == set(range(max(cells) + 1)) and len(cells) > 10
        plan = placed._jdf.queryExecution().optimizedPlan().toString()
        assert "slice(" not in plan and "aggregate(" in plan.split("Join")[0]
