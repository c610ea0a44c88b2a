"""Bounds of statistics by resampling that needs no resample.

The Poisson bootstrap gives every row a weight per replicate, drawn from a
Poisson distribution of mean 1, instead of drawing n rows of a group: weights
do not know the size of the group, so weighted sums merge before the shuffle.
The weights come from a hash of the row's key. They are the same in every run
and after a lost executor, and another engine can repeat them.

The bias-corrected and accelerated bounds of a median need neither weights nor
replicates: the bootstrap distribution of a median follows from the binomial
distribution, and its jackknife has three values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from freshet.functions.numbers import bca_ranks, ratio
from freshet.operators.censored import ros_values
from freshet.operators.lineage import cut
from freshet.operators.spread import GROUP_ROWS, drop_null_keys, interpolated, near_ranks, rank_of, ranked_values, value_at
from freshet.workers import ship

REPLICATES = 200
TAIL = 0.025
SEED = 42
#: Draws are below this prime, so that the weights of two replicates are independent.
PRIME = 2**31 - 1
MOMENTS = ("mean", "std", "cov")
#: Rows that meet their weights at a time, and keys whose sums a task holds before it passes them on.
CHUNK_ROWS = 2000
HELD_KEYS = 1000


def poisson_limits() -> list[int]:
    """The draws at which a Poisson variable of mean 1 passes to the next number."""
    limits, chance, total = [], math.exp(-1), 0.0
    for k in range(1, 40):
        total += chance
        chance /= k
        limits.append(math.floor(PRIME * total))
    return [x for x in sorted(set(limits)) if x < PRIME]


def row_key(keys: Sequence[str]) -> str:
    """SQL of the text that names a row, for Spark and others alike; null counts as empty."""
    return " || '|' || ".join(f"coalesce(CAST({k} AS {{text}}), '')" for k in keys)


def _hashes(key: str, seed: int) -> list[Column]:
    """``h1`` and ``h2`` of the row that the SQL ``key`` names."""
    digest = F.md5(F.expr(f"'{seed}:' || {key}"))
    return [F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9)]


def poisson_weights(keys: Sequence[str], replicates: int = REPLICATES, seed: int = SEED) -> Column:
    """One weight per replicate of a row: the ``b``-th draw is ``(h1 + b * h2) mod PRIME``.

    ``h1`` and ``h2`` are the first two groups of eight hexadecimal digits of
    the MD5 of ``seed:key|key...``. Rows with the same key get the same weights.
    """
    h1, h2 = _hashes(row_key(keys).format(text="STRING"), seed)
    hashes = F.array(F.struct(h1.alias("a"), h2.alias("b")))  # an argument of a lambda, so computed once a row

    def number(draw: Column) -> Column:
        limits = poisson_limits()
        chain = F.when(draw < limits[0], F.lit(0))
        for k, limit in enumerate(limits[1:], 1):
            chain = chain.when(draw < limit, F.lit(k))
        return chain.otherwise(F.lit(len(limits))).cast("tinyint")

    def weights(h: Column) -> Column:
        replicate = F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))
        return F.transform(F.transform(replicate, lambda b: (h["a"] + b * h["b"]) % PRIME), number)

    return F.get(F.transform(hashes, weights), F.lit(0))


def _drawn(h1: np.ndarray, h2: np.ndarray, replicates: int) -> np.ndarray:
    """:func:`poisson_weights` of some rows, a line per replicate."""
    prime = np.uint32(PRIME)
    at, step = (h1 % PRIME).astype(np.uint32), (h2 % PRIME).astype(np.uint32)
    draws = np.empty((replicates, len(at)), np.uint32)
    for b in range(replicates):
        draws[b] = at
        at = at + step
        at = np.minimum(at, at - prime)  # the smaller one is the remainder, since what is below zero wraps around
    weights = np.zeros(draws.shape, np.uint8)
    for limit in poisson_limits():
        weights += draws >= np.uint32(limit)
    return weights


def _sums_by_key(keys: list[str], factors: list[str], replicates: int):
    """Sums of the weights, and of their products with the factors, per key; of what a task holds at a time."""
    names = ["_w", *factors]

    def rows_of(held: dict) -> pa.RecordBatch:
        sums = np.stack(list(held.values()))
        offsets = np.arange(0, (len(held) + 1) * replicates, replicates, dtype=np.int32)
        lists = [pa.ListArray.from_arrays(offsets, np.ascontiguousarray(sums[:, k]).ravel()) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*[pa.array(column) for column in zip(*held)], *lists], [*keys, *names])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                part = {c: batch.column(c).slice(start, CHUNK_ROWS).to_numpy(zero_copy_only=False) for c in batch.schema.names}
                order = np.lexsort([part[k] for k in reversed(keys)])
                part = {c: v[order] for c, v in part.items()}
                new = np.any([part[k][1:] != part[k][:-1] for k in keys], axis=0)
                first = np.concatenate([[0], np.flatnonzero(new) + 1])
                weights = _drawn(part["_h1"], part["_h2"], replicates).astype(np.float64)
                sums = np.stack([np.add.reduceat(weights if f == "_w" else weights * part[f], first, axis=1) for f in names])
                for k, key in enumerate(zip(*[part[k][first].tolist() for k in keys])):
                    held[key] = held[key] + sums[:, :, k] if key in held else sums[:, :, k].copy()
                if len(held) >= HELD_KEYS:
                    yield rows_of(held)
                    held = {}
        if held:
            yield rows_of(held)

    return summed


def _weighted(rows: DataFrame, keys: list[str], factors: list[str], replicates: int) -> DataFrame:
    """Weighted sums of ``rows`` per key and replicate ``_b``: ``_w`` and the factors', in several parts that merge.

    ``rows`` have numbers as keys, the factors and the hashes ``_h1`` and ``_h2``.
    """
    ship(rows.sparkSession)
    arrays = {c: T.ArrayType(T.DoubleType()) for c in ["_w", *factors]}
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, t) for c, t in arrays.items()])
    parts = rows.select(*keys, *factors, "_h1", "_h2").mapInArrow(_sums_by_key(keys, factors, replicates), schema)
    drawn = parts.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("_b", "_s")).select(*keys, "_b", "_s.*")
    return drawn.where("_w > 0")


def bootstrap_bounds(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    statistics: dict[str, str | float],
    keys: Sequence[str],
    replicates: int = REPLICATES,
    tail: float = TAIL,
    seed: int = SEED,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Statistics per group with their percentile bounds from a Poisson bootstrap.

    ``statistics`` names ``'mean'``, ``'std'`` (of a sample), ``'cov'`` (their
    ratio) or a percentile as a number between 0 and 1 (linearly
    interpolated); each gives the columns ``name``, ``name_lower`` and
    ``name_upper``, beside ``n``. ``keys`` name a row (see
    :func:`poisson_weights`). Null values and rows with a null group key are
    left out. Replicates in which a statistic is not defined, such as those
    without rows, do not count; if it is in none, its bounds are null. A row
    meets its weights as it is read; what is shuffled are sums, one row per
    group and replicate from a task that reads few groups.

    The percentile of a replicate lies near the one of the group: within five
    times the square root of n ranks and 25 more, ten standard deviations. Only
    values in this band are sorted, merged to one row per value before; all
    others enter as sums.
    """
    by, points = list(by), {k: s for k, s in statistics.items() if not isinstance(s, str)}
    moments = {k: s for k, s in statistics.items() if isinstance(s, str)}
    if unknown := set(moments.values()) - set(MOMENTS):
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    if any(not 0 < p < 1 for p in points.values()):
        raise ValueError("percentiles lie between 0 and 1")
    known = drop_null_keys(df, by).na.drop(subset=[value]).select(
        *[F.col(c) for c in by], F.col(value).cast("double").alias("_v"), F.expr(row_key(keys).format(text="STRING")).alias("_key")
    )
    totals = {"_mean": F.avg("_v"), "_std": F.stddev_samp("_v")}
    if points:
        ranks, edges = [], []
        for name, p in points.items():
            margin = "(5 * sqrt(n_total) + 25)"
            low, high = f"greatest(floor({rank_of(p)} - {margin}), 0)", f"least(ceil({rank_of(p)} + {margin}), n_total - 1)"
            ranks += [low, rank_of(p), high]
            edges += [interpolated(p, "_v").alias(name), value_at(low, "_v").alias(f"_lo_{name}"), value_at(high, "_v").alias(f"_hi_{name}")]
        found, ranked = near_ranks(known, by, "_v", ranks, totals, group_rows)
        groups = found.withColumnRenamed("n_total", "n").join(ranked.groupBy(*by).agg(*edges), by)
    else:
        groups = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in totals.items()])
    groups = cut(groups.withColumn("_group", F.monotonically_increasing_id()))
    h1, h2 = _hashes("_key", seed)
    rows = known.join(groups, by).withColumns({"_h1": h1, "_h2": h2, "_off": F.col("_v") - F.col("_mean")})
    factors = {"_first": F.col("_off"), "_second": F.col("_off") * F.col("_off")} if moments else {}
    factors |= {f"_below_{p}": (F.col("_v") < F.col(f"_lo_{p}")).cast("double") for p in points}
    sums = _weighted(rows.withColumns(factors) if factors else rows, ["_group"], list(factors), replicates)
    totalled = sums.groupBy("_group", "_b").agg(F.sum("_w").cast("long").alias("_weights"), *[F.sum(c).alias(c) for c in factors])
    replicate = cut(totalled)
    drawn = replicate
    for name, p in points.items():
        band = _weighted(rows.where(F.col("_v").between(F.col(f"_lo_{name}"), F.col(f"_hi_{name}"))), ["_group", "_v"], [], replicates)
        drawn = drawn.join(_replicate_percentiles(band, replicate, name, p), ["_group", "_b"], "left")
    drawn = drawn.join(groups.select("_group", *by, "_mean"), "_group")
    stats = {"mean": F.col("_mean"), "std": F.col("_std"), "cov": ratio(F.col("_std"), F.col("_mean"))}
    columns = [stats[s].alias(k) if isinstance(s, str) else F.col(k) for k, s in statistics.items()]
    found = {k: F.expr(_of_sums(s)) if isinstance(s, str) else F.col(f"_value_{k}") for k, s in statistics.items()}
    bounds = [F.percentile(found[k], F.lit(t)).alias(f"{k}_{side}") for k in statistics for side, t in (("lower", tail), ("upper", 1 - tail))]
    named = [f"{k}_{side}" for k in statistics for side in ("lower", "upper")]
    return groups.select(*by, "n", *columns).join(drawn.groupBy(*by).agg(*bounds), by, "left").select(*by, "n", *statistics, *named)


def _of_sums(kind: str) -> str:
    """SQL of a replicate's statistic from its sums around the mean of the group."""
    mean = "CASE WHEN _weights > 0 THEN _mean + _first / _weights END"
    std = "CASE WHEN _weights > 1 THEN sqrt(greatest(_second - _first * _first / _weights, 0D) / (_weights - 1)) END"
    return {"mean": mean, "std": std, "cov": f"({std}) / nullif({mean}, 0D)"}[kind]


def _replicate_percentiles(band: DataFrame, replicate: DataFrame, name: str, p: float) -> DataFrame:
    """``_value_<name>``: the percentile of each replicate, from the values of the band."""
    by = ["_group", "_b"]
    merged = band.groupBy(*by, "_v").agg(F.sum("_w").cast("long").alias("_w"))
    lanes = merged.join(replicate.select(*by, "_weights", F.col(f"_below_{name}").cast("long").alias("_below")), by)
    upto = F.sum("_w").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    h = f"((_weights - 1) * {p!r}D)"
    low, high = (F.min(F.expr(f"CASE WHEN _upto > {side}({h}) THEN _v END")) for side in ("floor", "ceil"))
    placed = lanes.withColumn("_upto", F.col("_below") + upto)
    each = placed.groupBy(*by).agg(low.alias("_low"), high.alias("_high"), F.max(F.expr(f"{h} - floor({h})")).alias("_part"))
    return each.select(*by, (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias(f"_value_{name}"))


def bca_median_bounds(
    df: DataFrame,
    by: Sequence[str],
    rescol: str = "concentration",
    qualcol: str = "qualifier",
    ndvals: Sequence[str] = ("<",),
    tail: float = TAIL,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """ROS median per group with bias-corrected and accelerated bootstrap bounds (Efron 1987).

    The distribution of a resample's median over the rows is binomial (see
    ``censored.bootstrap_median_bounds``); of the two middle rows of an even
    number, the correction takes the mean of both chances. Rows equal to the
    median count half. Leaving one row out moves the median to one of three
    values, by the side on which the row lies, so the acceleration follows from
    the rows beside the middle. A group of one row, or of equal rows, has its
    median as both bounds.
    """
    by, value = list(by), f"ros_{rescol}"
    ranked = ranked_values(ros_values(df, by, rescol, qualcol, ndvals, group_rows), by, value, group_rows=group_rows)
    low, high = "floor((n_total - 1) / 2)", "ceil((n_total - 1) / 2)"

    def at(rank: str, what: str) -> Column:
        return F.expr(f"max(CASE WHEN n_below <= {rank} AND {rank} < n_below + n THEN {what} END)")

    middle = cut(
        ranked.groupBy(*by).agg(
            F.max("n_total").alias("_n"), interpolated(0.5, value).alias("median"),
            at(low, value).alias("_low"), at(high, value).alias("_high"),
            at(f"greatest({low} - 1, 0)", value).alias("_before"), at(f"least({high} + 1, n_total - 1)", value).alias("_after"),
            at(low, "n_below").alias("_lt"), at(high, "n_below + n").alias("_le"),
        )
    )
    # rows strictly below the median, and those up to it: different middle rows of an even number have none in between
    half = F.expr("_n DIV 2")
    apart = F.col("_low") < F.col("_high")
    levels = middle.select(
        *by, "median", "_n", F.when(apart, half).otherwise(F.col("_lt")).alias("_lt"), F.when(apart, half).otherwise(F.col("_le")).alias("_le"),
        _acceleration().alias("_a"),
    )
    rows = cut(levels.withColumn("_ranks", bca_ranks("_n", "_lt", "_le", "_a", tail)))
    found = ranked.join(rows.select(*by, "_ranks"), by).groupBy(*by).agg(
        value_at("_ranks.low", value).alias("lower"), value_at("_ranks.high", value).alias("upper")
    )
    return rows.join(found, by).select(*by, "lower", "median", "upper", F.col("_n").alias("n"), F.col("_a").alias("acceleration"))


def _acceleration() -> Column:
    """Skewness of the leave-one-out medians over six, from the rows beside the middle.

    An even number of rows leaves two medians as often as each other: no skew.
    Rows that differ by rounding alone (a billionth of the median) count as equal.
    """
    side, one = F.expr("(_n - 1) DIV 2"), F.lit(1).cast("long")
    medians = F.array(
        F.struct(F.expr("(_low + _after) / 2").alias("m"), side.alias("c")),
        F.struct(F.expr("(_before + _low) / 2").alias("m"), side.alias("c")),
        F.struct(F.expr("(_before + _after) / 2").alias("m"), one.alias("c")),
    )

    def total(of) -> Column:
        return F.aggregate(medians, F.lit(0.0), lambda s, x: s + of(x))

    mean = total(lambda x: x["m"] * x["c"]) / F.col("_n")
    cubes = total(lambda x: F.pow(mean - x["m"], F.lit(3.0)) * x["c"])
    squares = total(lambda x: F.pow(mean - x["m"], F.lit(2.0)) * x["c"])
    skewed = (F.col("_n") % 2 == 1) & (F.col("_n") > 2) & (squares > F.pow(F.col("median") * 1e-9, F.lit(2.0)))
    return F.when(skewed, cubes / (6 * F.pow(squares, F.lit(1.5)))).otherwise(0.0)
