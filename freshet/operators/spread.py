"""Ordered computations over groups of any size.

A window partitioned by the group alone puts one group into one task. That is
the right plan while every group is small, so the distinct values of the
groups are counted first. Where a group has more than ``GROUP_ROWS`` of them,
the groups are cut into *cells*, consecutive ranges of the ordering value: a
task sorts one cell, and what a cell needs to know about the cells before and
after it comes from a table with one row per cell.

The cut points of a group are values of the group itself, picked by a hash of
the value. They depend on nothing but the data, so a recomputed task (lost
executor) draws the same cells, and they fall evenly over the distinct values
whatever their distribution.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.operators.lineage import BROADCAST_ROWS, broadcast_if_small, cut, rows_of

CELL = "_cell"
GROUP_ROWS = 1_000_000
SLOTS = 256
OVERSAMPLE = 16
BLOCK_ROWS = 10_000
#: Steps of the approximate percentiles around which values are kept; their error is a twenty-fifth of a step.
GRID = 200
BAND_ROWS = 20_000


def drop_null_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows whose group keys are all known, the rows that can form groups."""
    return df.na.drop(subset=list(by)) if by else df


def largest_group(values: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; one number reaches the driver."""
    return values.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def cut_groups(
    values: DataFrame, by: Sequence[str], value: str, group_rows: int = GROUP_ROWS, slots: int = SLOTS, rows: int | None = None
) -> DataFrame:
    """Add ``_cell`` to the values if some group is too large for one task.

    ``values`` holds each (group, value) once, no nulls in either, and is
    cheap to read again (see :func:`freshet.operators.lineage.cut`). Groups of
    up to ``group_rows`` values are one cell, -1. ``rows`` bounds the number of
    values where it is known; groups are counted only if one can be too large.
    """
    by = list(by)
    if rows is not None and rows <= group_rows:
        return values
    largest = largest_group(values, by)
    if largest <= group_rows:
        return values
    slots = max(slots, -(-largest // group_rows))  # a cell stays as large however the data grow
    picks = (
        values.withColumn("_slot", F.pmod(F.xxhash64(value), F.lit(slots * OVERSAMPLE)))
        .groupBy(*by, "_slot")
        .agg(F.min_by(value, F.xxhash64(F.col(value), F.lit(17))).alias("_pick"), F.count(F.lit(1)).alias("_rows"))
    )
    # a group has at most slots * OVERSAMPLE picks; cuts are evenly spaced among them
    cuts = (
        picks.groupBy(*by)
        .agg(F.sort_array(F.collect_list("_pick")).alias("_picks"), F.sum("_rows").alias("_rows"))
        .filter(F.col("_rows") > group_rows)
        .withColumn("_cuts", F.expr(f"filter(_picks, (c, i) -> (i + 1) % greatest(1, size(_picks) div {slots}) = 0)"))
        .drop("_rows", "_picks")
    )
    # binary search for the number of cuts up to the value; there are fewer than 2 * slots
    halves = ", ".join(str(1 << k) for k in reversed(range((2 * slots).bit_length())))
    position = f"aggregate(array({halves}), 0, (at, half) -> IF(get(_cuts, at + half - 1) <= {value}, at + half, at))"
    # one row of cuts per large group
    return (
        values.join(broadcast_if_small(cuts, 10_000), by, "left")
        .withColumn(CELL, F.expr(f"CASE WHEN _cuts IS NULL THEN -1 ELSE {position} END"))
        .drop("_cuts")
    )


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` of ``column`` over the rows on one side.

    ``sum_before`` and ``max_upto`` look back (excluding / including the row),
    ``sum_after`` and ``min_after`` look ahead (excluding the row), and
    ``sum_overall`` takes the whole group.
    """

    name: str
    kind: str
    column: Column


def _frame(keys: list[str], order: str, side: str):
    """Window frame of one side. Looking ahead is looking back in descending
    order: Spark extends a frame that starts unbounded, but recomputes one
    that ends unbounded for every row."""
    rows = Window.partitionBy(*keys)
    if side == "overall":
        return rows
    if side == "after":
        return rows.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if side == "upto" else -1)


_AGGS = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(agg: str, inner: Column, outer: Column) -> Column:
    if agg == "sum":
        return F.coalesce(inner, F.lit(0)) + F.coalesce(outer, F.lit(0))
    return (F.greatest if agg == "max" else F.least)(inner, outer)


def running(df: DataFrame, by: Sequence[str], value: str, specs: Sequence[Running]) -> DataFrame:
    """Add running values over each whole group, ordered by ``value``.

    ``df`` comes from :func:`cut_groups`; it holds each (group, value) once.
    """
    by = list(by)
    parts = [(s, *s.kind.split("_")) for s in specs]
    in_cells = CELL in df.columns
    keys = [*by, CELL] if in_cells else by
    inner = {s.name: _AGGS[agg](s.column).over(_frame(keys, value, side)) for s, agg, side in parts}
    if not in_cells:
        return df.withColumns(
            {s.name: F.coalesce(inner[s.name], F.lit(0)) if agg == "sum" else inner[s.name] for s, agg, _ in parts}
        )

    # the row's own cell is counted inside it, so "upto" and "overall" leave it out here
    def outer(agg: str, side: str, name: str) -> Column:
        def over(s: str) -> Column:
            return _AGGS[agg](name).over(_frame(by, CELL, s))

        if side == "overall":
            return _merge(agg, over("before"), over("after"))
        return over("before" if side == "upto" else side)

    edges = (
        df.filter(F.col(CELL) >= 0)
        .groupBy(*by, CELL)
        .agg(*[_AGGS[agg](s.column).alias(f"_whole_{s.name}") for s, agg, _ in parts])
        .select(
            *by,
            CELL,
            *[
                outer(agg, side, f"_whole_{s.name}").alias(f"_outer_{s.name}")
                for s, agg, side in parts
            ],
        )
    )
    merged = (
        df.withColumns({f"_inner_{name}": c for name, c in inner.items()})
        .join(edges, [*by, CELL], "left")
        .withColumns(
            {s.name: _merge(agg, F.col(f"_inner_{s.name}"), F.col(f"_outer_{s.name}")) for s, agg, _ in parts}
        )
    )
    return merged.drop(*[f"_{p}_{s.name}" for s in specs for p in ("inner", "outer")])


def count_values(
    df: DataFrame, by: Sequence[str], value: str, counters: dict[str, Column] | None = None
) -> DataFrame:
    """Each distinct value of each group with its rows ``n``, computed once.

    ``counters`` adds sums over the rows with the value. Rows with a null key
    are left out; a null value is kept, as a value of its own.
    """
    return cut(
        drop_null_keys(df, by)
        .groupBy(*by, value)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(name) for name, c in (counters or {}).items()],
        )
    )


def rank_counted(
    counted: DataFrame, by: Sequence[str], value: str, group_rows: int = GROUP_ROWS, rows: int | None = None
) -> DataFrame:
    """Add ranks to counted values without nulls (see :func:`ranked_values`)."""
    return running(
        cut_groups(counted, by, value, group_rows, rows=rows),
        by,
        value,
        [Running("n_below", "sum_before", F.col("n")), Running("n_total", "sum_overall", F.col("n"))],
    )


def ranked_values(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    counters: dict[str, Column] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Each distinct value of each group with its rank.

    Gives ``by``, ``value``, ``n`` (rows with the value), ``n_below`` (rows of
    the group with a smaller value), ``n_total`` (rows of the group) and one
    column per counter (a sum over the rows with the value). Rows are counted
    before they are shuffled; null values and null keys are left out.
    """
    counted = count_values(df.na.drop(subset=[value]), by, value, counters)
    return rank_counted(counted, by, value, group_rows, rows_of(counted))


def numbered(df: DataFrame, keys: Sequence[str], count: str, number: str, block: int = BLOCK_ROWS) -> DataFrame:
    """Each row as often as ``count`` says, numbered from 1.

    Blocks of numbers are dealt out before they are expanded, so the copies of
    a row with a large count are made by several tasks and never sit in one array.
    """
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / block) - 1)))
    # copies of one row are spread by their block; AQE merges what is small
    dealt = blocks.repartition(*keys, "_block")
    first, last = F.col("_block") * block + 1, F.least(F.col(count), (F.col("_block") + 1) * block)
    return dealt.withColumn(number, F.explode(F.sequence(first, last))).drop("_block")


def _value_at(rank: str, value: str) -> str:
    return f"max(CASE WHEN n_below <= {rank} AND {rank} < n_below + n THEN {value} END)"


def value_at(rank: str, value: str) -> Column:
    """Aggregate: the value whose 0-based rank is ``rank``, over ranked values."""
    return F.expr(_value_at(rank, value))


def rank_of(prob: float) -> str:
    """SQL of the 0-based rank, a fraction perhaps, of a linearly interpolated percentile."""
    return f"((n_total - 1) * {float(prob)!r}D)"


def interpolated(prob: float, value: str) -> Column:
    """Aggregate: the linearly interpolated percentile, over ranked values."""
    h = rank_of(prob)
    low, high = _value_at(f"floor({h})", value), _value_at(f"ceil({h})", value)
    return F.expr(f"{low} + max({h} - floor({h})) * ({high} - {low})")


def near_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    ranks: Sequence[str],
    totals: dict[str, Column] | None = None,
    group_rows: int = GROUP_ROWS,
    band_rows: int = BAND_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The groups, and their values around some ranks as :func:`ranked_values` has them.

    ``ranks`` are SQL of 0-based ranks in terms of ``n_total``, the rows of the
    group with a value. Approximate percentiles of known error bound the values
    that can have a rank; all others, which no rank can fall on, are counted
    into one row per gap before the shuffle. So ranks and values are exact, and
    a few hundredths of the rows are sorted. Groups of up to ``band_rows`` rows
    are kept whole.

    The groups are read first and computed once, with ``n_total`` and the aggregates of
    ``totals``, and hold those without values too. Rows with null keys are left out.
    """
    by, band_rows = list(by), min(band_rows, group_rows)
    known = drop_null_keys(df, by)
    number = F.when(~F.isnan(value), F.col(value))  # NaN sorts last, but has no place among percentiles
    found = known.groupBy(*by).agg(
        F.count(value).alias("n_total"), F.count(number).alias("_numbers"), *[c.alias(name) for name, c in (totals or {}).items()]
    )
    groups = cut(found.withColumn("_group", F.monotonically_increasing_id()))
    values = known.select(*by, value).filter(F.col(value).isNotNull())

    def of_groups(rows: DataFrame, few: DataFrame) -> DataFrame:
        few = F.broadcast(few) if rows_of(groups) <= BROADCAST_ROWS else few
        return rows.join(few, by) if by else rows.crossJoin(few)

    large = groups.filter((F.col("n_total") > band_rows) & (F.col("_numbers") > 0))
    if large.isEmpty():
        return groups.drop("_group", "_numbers"), rank_counted(count_values(values, by, value), by, value, group_rows, band_rows)
    # a sketch per number of a group, which is sorted faster than its keys where Spark sorts the rows
    steps = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    numbers = of_groups(values, large.select(*by, "_group")).select("_group", number.alias("_number"))
    grid = numbers.groupBy("_group").agg(F.percentile_approx("_number", steps, 25 * GRID).alias("_grid"))
    edges = {}
    for k, rank in enumerate(ranks):
        low, high = f"floor(floor({rank}) * {GRID} / _numbers) - 1", f"ceil((ceil({rank}) + 1) * {GRID} / _numbers) + 1"
        edges[f"_low_{k}"] = F.expr(f"CASE WHEN _grid IS NULL OR {low} < 0 THEN NULL ELSE _grid[CAST(least({low}, {GRID - 1}) AS INT)] END")
        edges[f"_high_{k}"] = F.expr(f"CASE WHEN _grid IS NULL OR {high} > {GRID} THEN NULL ELSE _grid[CAST({high} AS INT)] END")
    bands = cut(groups.join(grid, "_group", "left").select(*by, *[c.alias(name) for name, c in edges.items()]))
    placed = of_groups(values, bands)
    reached = " OR ".join(f"({value} >= coalesce(_low_{k}, {value}) AND {value} <= coalesce(_high_{k}, {value}))" for k in range(len(ranks)))
    passed = " + ".join(f"CASE WHEN {value} > _high_{k} THEN 1 ELSE 0 END" for k in range(len(ranks)))
    merged = placed.groupBy(
        *by, F.expr(f"CASE WHEN {reached} THEN {value} END").alias("_kept"), F.expr(f"CASE WHEN {reached} THEN -1 ELSE {passed} END").alias("_gap")
    ).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n"))
    counted = cut(merged.drop("_kept", "_gap"))
    return groups.drop("_group", "_numbers"), rank_counted(counted, by, value, group_rows, rows_of(counted))


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, one column each."""
    _, ranked = near_ranks(df.na.drop(subset=[value]), by, value, [rank_of(p) for p in probs.values()], group_rows=group_rows)
    return ranked.groupBy(*by).agg(*[interpolated(p, value).alias(name) for name, p in probs.items()])
