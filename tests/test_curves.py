import math
import random
import statistics
from collections import defaultdict

import pytest

from freshet.plans.curves import density, thinned_points


def drawn(points, lo, hi, width, height=200, ylo=-3.5, yhi=3.5):
    """Pixels of a line through points: in each column, all rows between the lowest and the highest spot of the line."""
    def column(x):
        return (x - lo) * width // (hi - lo + 1)

    def row(y):
        return math.floor((y - ylo) / (yhi - ylo) * height)

    # the line changes columns between two points only where both draws agree: from the last of one to the first of the next
    spans, joins = {}, set()
    points = sorted(points)
    for x, y in points:
        c, r = column(x), row(y)
        a, b = spans.get(c, (r, r))
        spans[c] = (min(a, r), max(b, r))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if column(x0) != column(x1):
            joins.add((x0, y0, x1, y1))
    return spans, joins


def test_the_thinned_line_is_the_same_line(spark):
    rng = random.Random(1)
    series = {
        "a": [(k * 7 + rng.randrange(5), rng.gauss(0, 1)) for k in range(5000)],
        "b": [(k, float(k % 3)) for k in range(40)],
        "c": [(5, 1.0)] * 4,
        "d": [(k // 50, rng.choice([0.0, 1.0, 2.0])) for k in range(3000)],
    }
    rows = [(s, x, y) for s, points in series.items() for x, y in points] + [("a", None, 1.0), ("a", 1, None), (None, 1, 1.0)]
    df = spark.createDataFrame(rows, "s string, x long, y double").repartition(4)
    for width in (1, 13, 100):
        found = defaultdict(list)
        for r in thinned_points(df, ["s"], "x", "y", width).collect():
            found[r.s].append((r.x, r.y))
        assert set(found) == set(series)
        for s, points in series.items():
            lo, hi = min(points)[0], max(points)[0]
            assert len(found[s]) <= 4 * width and set(found[s]) <= set(points)
            assert drawn(found[s], lo, hi, width) == drawn(points, lo, hi, width)


def test_times_and_doubles(spark):
    times = spark.sql("SELECT 'a' AS s, timestamp_ntz'2011-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts, sin(id) AS y FROM range(3000)")
    assert 40 < thinned_points(times, ["s"], "ts", "y", 12).count() <= 48
    numbers = spark.createDataFrame([("a", k / 7, float(k)) for k in range(100)] + [("b", 1.5, 1.0)], "s string, x double, y double")
    found = {(r.s, r.x) for r in thinned_points(numbers, ["s"], "x", "y", 10).collect()}
    assert ("a", 0.0) in found and ("a", 99 / 7) in found and ("b", 1.5) in found and len(found) <= 41
    assert thinned_points(numbers.limit(0), ["s"], "x", "y", 5).collect() == []
    with pytest.raises(ValueError):
        thinned_points(numbers, ["s"], "x", "y", 0)


def direct(values, steps, bandwidths=None):
    """The sum over all cells at every cell in reach."""
    d, n = len(steps), len(values)
    cells = defaultdict(int)
    for v in values:
        cells[tuple(math.floor(c / s) for c, s in zip(v, steps))] += 1
    h = []
    for k, s in enumerate(steps):
        sd = statistics.stdev(v[k] for v in values) if n > 1 else 0.0
        h.append(bandwidths[k] if bandwidths else sd * n ** (-1 / (d + 4)) or s)
    def at(g):
        total = 0.0
        for c, m in cells.items():
            z = sum(((a - b) * s / w) ** 2 for a, b, s, w in zip(g, c, steps, h))
            total += m * math.exp(-z / 2)
        return total / n / math.prod(w * math.sqrt(2 * math.pi) for w in h)
    return at, cells


@pytest.mark.parametrize("bandwidths", [None, {"x": 0.7, "y": 1.1}])
@pytest.mark.parametrize("steps", [{"x": 0.5}, {"x": 0.5, "y": 1.0}])
def test_density_is_the_direct_sum(spark, steps, bandwidths):
    rng = random.Random(3)
    groups = {"a": [(rng.gauss(0, 2), rng.gauss(5, 1)) for _ in range(60)], "b": [(1.0, 1.0)] * 3, "c": [(2.0, -1.0)]}
    rows = [(g, *v) for g, vs in groups.items() for v in vs] + [("a", None, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = density(df, ["g"], steps, bandwidths and {q: bandwidths[q] for q in steps}).collect()
    names, widths = list(steps), list(steps.values())
    mass = defaultdict(float)
    rng.shuffle(found)
    kept = {g: direct([v[: len(names)] for v in vs], widths, bandwidths and [bandwidths[q] for q in names]) for g, vs in groups.items()}
    for k, r in enumerate(found):
        mass[r.g] += r.density * math.prod(widths)
        if k < 1500:
            spot = [math.floor(r[q] / s) for q, s in zip(names, widths)]
            assert r.density == pytest.approx(kept[r.g][0](spot), abs=1e-9)
    assert {r.g for r in found} == set(groups)
    assert all(0.95 < mass[g] < 1.05 for g in ("a",))


def test_density_of_nothing(spark):
    none = spark.createDataFrame([], "g string, x double")
    assert density(none, ["g"], {"x": 1}).collect() == []
    with pytest.raises(ValueError):
        density(none, ["g"], {"x": 0})
