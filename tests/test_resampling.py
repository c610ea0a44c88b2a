import hashlib
import math
import random
from statistics import NormalDist, mean, median, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.operators import resampling
from freshet.operators.resampling import (
    PRIME,
    bca_median_bounds,
    bootstrap_bounds,
    poisson_limits,
    poisson_weights,
)

B = 40


def plain_weights(key, replicates=B, seed=42):
    digest = hashlib.md5(f"{seed}:{key}".encode()).hexdigest()
    h1, h2 = int(digest[:8], 16), int(digest[8:16], 16)
    limits = poisson_limits()
    return [sum((h1 + b * h2) % PRIME >= x for x in limits) for b in range(replicates)]


def plain_bounds(rows, statistic, tail=0.025):
    found = []
    for b in range(B):
        drawn = [v for key, v in rows for _ in range(plain_weights(key)[b])]
        try:
            found.append(statistic(drawn))
        except (ValueError, ZeroDivisionError, IndexError, ArithmeticError):
            pass
    return tuple(np.quantile(found, [tail, 1 - tail])) if found else (None, None)


STATISTICS = {
    "mean": ("mean", lambda x: mean(x)),
    "sd": ("std", lambda x: stdev(x)),
    "cv": ("cov", lambda x: stdev(x) / mean(x)),
    "p90": (0.9, lambda x: float(np.quantile(x, 0.9)) if x else [][0]),
    "p05": (0.05, lambda x: float(np.quantile(x, 0.05)) if x else [][0]),
}


def groups(seed):
    rng = random.Random(seed)
    out = {"many": 400, "few": 7, "two": 2, "one": 1, "ties": 150}
    return [(g, f"{g}{k}", rng.choice([1.0, 2.0, 2.0, 5.0]) if g == "ties" else rng.lognormvariate(1, 1)) for g, n in out.items() for k in range(n)]


def test_bounds_are_those_of_plain_weighted_resamples(spark):
    rows = groups(3)
    df = spark.createDataFrame(rows + [("one", "x", None), (None, "y", 3.0)], "g string, id string, v double").repartition(3)
    wanted = {k: s for k, (s, _) in STATISTICS.items()}
    found = bootstrap_bounds(df, ["g"], "v", wanted, ["g", "id"], replicates=B).collect()
    assert sorted(r.g for r in found) == sorted({g for g, _, _ in rows})
    for r in found:
        mine = [(f"{g}|{i}", v) for g, i, v in rows if g == r.g]
        assert r.n == len(mine)
        for name, (_, statistic) in STATISTICS.items():
            low, high = plain_bounds(mine, statistic)
            assert (r[f"{name}_lower"], r[f"{name}_upper"]) == pytest.approx((low, high), rel=1e-9), (r.g, name)
        assert r.p90 == pytest.approx(np.quantile([v for _, v in mine], 0.9))
        assert (r.sd is None) == (r.n == 1)


def test_weights_are_poisson_of_mean_one_and_independent(spark):
    weights = np.array([r.w for r in spark.range(4000).select(poisson_weights(["id"], 60).alias("w")).collect()])
    assert weights[17].tolist() == plain_weights("17", 60)
    share = [np.mean(weights == k) for k in range(4)]
    assert share == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.01)
    assert abs(np.corrcoef(weights.T) - np.eye(60)).max() < 0.08


def test_bounds_cover_the_mean_about_as_often_as_they_say(spark):
    rng = random.Random(9)
    rows = [(g, k, rng.gauss(10, 3)) for g in range(200) for k in range(60)]
    found = bootstrap_bounds(spark.createDataFrame(rows, "g long, k long, v double"), ["g"], "v", {"m": "mean"}, ["g", "k"], 100, 0.05)
    hits = found.where("10 between m_lower and m_upper").count()
    assert 165 <= hits <= 195  # 90 %


def test_empty_tables_and_wrong_names(spark):
    empty = spark.createDataFrame([], "g string, id long, v double")
    assert bootstrap_bounds(empty, ["g"], "v", {"m": "mean", "p": 0.5}, ["id"], 5).collect() == []
    for wrong in ({"m": "median"}, {"p": 1.5}):
        with pytest.raises(ValueError):
            bootstrap_bounds(empty, ["g"], "v", wrong, ["id"])


def test_weighted_rows_are_summed_before_they_are_shuffled(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(resampling, "cut", lambda df: kept.append(df) or df)
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id", F.rand(1).alias("v"))
    bootstrap_bounds(df, ["g"], "v", {"m": "mean"}, ["id"], 5)
    plan = kept[1]._jdf.queryExecution().sparkPlan().toString().split("\n")
    first = [line.split("(")[0].strip(" +-:*").split()[0] for line in plan if "Aggregate" in line or "Generate" in line][:3]
    assert first == ["HashAggregate", "HashAggregate", "Generate"]  # final, partial, and below it the weights


def plain_bca(values, tail=0.025):
    """Bias, acceleration and distribution one by one, the jackknife by leaving each row out."""
    x, n = sorted(values), len(values)
    middle, normal = median(x), NormalDist()

    def chance(k, r):
        return sum(math.comb(n, j) * (k / n) ** j * (1 - k / n) ** (n - j) for j in range(r, n + 1))

    lt, le = sum(v < middle for v in x), sum(v <= middle for v in x)
    low_r, high_r = (n + 1) // 2, n // 2 + 1
    z0 = normal.inv_cdf(sum(chance(k, r) for k in (lt, le) for r in (low_r, high_r)) / 4)
    left = [median(x[:i] + x[i + 1 :]) for i in range(n)] if n > 1 else [middle]
    d = [mean(left) - v for v in left]
    squares = sum(v * v for v in d)
    a = sum(v**3 for v in d) / (6 * squares**1.5) if squares > (middle * 1e-9) ** 2 else 0.0
    out = []
    for z, r in ((normal.inv_cdf(tail), low_r), (normal.inv_cdf(1 - tail), high_r)):
        level = normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
        out.append(next(x[k - 1] for k in range(1, n + 1) if chance(k, r) >= level or k == n))
    return out[0], middle, out[1], a


def test_bca_is_plain_bca_on_fifty_groups(spark):
    rng = random.Random(4)
    rows = {}
    for g in range(50):
        n = rng.randint(1, 60)
        rows[g] = [round(rng.lognormvariate(0, 1.5), rng.choice([1, 4])) for _ in range(n)]
    rows[50] = [2.0] * 9
    rows[51] = [0.1 + 0.2, 0.3, 0.3]  # equal but for rounding
    flat = [(g, v, "=") for g, values in rows.items() for v in values] + [(None, 1.0, "="), (3, None, "=")]
    found = bca_median_bounds(spark.createDataFrame(flat, "g long, concentration double, qualifier string"), ["g"]).collect()
    assert len(found) == 52
    for r in found:
        low, middle, high, a = plain_bca(rows[r.g])
        assert (r.lower, r.median, r.upper) == pytest.approx((low, middle, high)), r.g
        assert r.acceleration == pytest.approx(a, abs=1e-9) and r.n == len(rows[r.g])


def test_bca_of_nothing(spark):
    assert bca_median_bounds(spark.createDataFrame([], "g long, concentration double, qualifier string"), ["g"]).collect() == []


def test_weights_of_many_rows_at_once(spark):
    """Sums come from arrays of rows; the weights are those of the column, at the ends of the hashes too."""
    rng = random.Random(2)
    ends = [0, 1, PRIME - 1, PRIME, PRIME + 1, 2**32 - 1]
    pairs = [(a, b) for a in ends for b in ends] + [(rng.randrange(2**32), rng.randrange(2**32)) for _ in range(50)]
    h1, h2 = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    limits = poisson_limits()
    want = [[sum((a + b * c) % PRIME >= x for x in limits) for a, c in pairs] for b in range(60)]
    assert resampling._drawn(h1, h2, 60).tolist() == want


def test_sums_do_not_depend_on_how_many_keys_a_task_holds(spark, monkeypatch):
    rows = groups(5)
    df = spark.createDataFrame(rows, "g string, id string, v double").repartition(3)
    wanted = {k: s for k, (s, _) in STATISTICS.items()}
    whole = {r.g: r for r in bootstrap_bounds(df, ["g"], "v", wanted, ["g", "id"], replicates=B).collect()}
    monkeypatch.setattr(resampling, "CHUNK_ROWS", 7)
    monkeypatch.setattr(resampling, "HELD_KEYS", 2)
    for r in bootstrap_bounds(df, ["g"], "v", wanted, ["g", "id"], replicates=B).collect():
        assert [*r][1:] == pytest.approx([*whole[r.g]][1:])
