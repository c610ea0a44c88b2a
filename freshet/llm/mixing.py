"""Mixing sources to target weights: token budgets down a domain-language-source tree, then document prefixes.

A node's budget is dealt to its children by weight. What a child cannot use,
because its whole subtree holds less, goes to its siblings by weight; only what
all siblings together cannot use is missing further up, where the node's own
siblings got it in the same way. All sums are whole numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import WORD, written

SEED = 42
#: Documents that a cell of a leaf's order holds on average, whatever the size of the leaf.
CELL_ROWS = 10_000
NONE = "(none)"


def n_tokens(text_col: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(level: str, weights: Mapping[str, int], other: int = 1) -> Column:
    """The weight of a level's values; ``other`` is that of values not named."""
    if other < 1 or any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    named = [x for value, w in weights.items() for x in (F.lit(value), F.lit(int(w)))]
    return F.coalesce(F.create_map(*named)[F.col(level)] if named else F.lit(None), F.lit(other)).cast("long")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def deal_out(children: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """Adds ``allot``: each child's part of its parent's ``budget``, by ``weight`` and up to ``capacity``.

    Children are taken from the scarcest (capacity per weight) on. One that
    gets its fill when all that come after it get as much per weight is full;
    the others share the rest by weight, rounded down.
    """
    family = Window.partitionBy(*parents)
    order = family.orderBy(F.col("capacity") / F.col("weight"), child)
    before = F.coalesce(F.sum(_exact(F.col("capacity"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), _exact(F.lit(0)))
    weight_left = F.sum(_exact(F.col("weight"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    used = _exact(before) * _exact(F.col("weight")) + _exact(F.col("capacity")) * _exact(weight_left)
    judged = children.withColumn("full", used <= _exact(F.col("budget")) * _exact(F.col("weight")))
    rest = _exact(F.col("budget")) - _exact(F.coalesce(F.sum(F.when(F.col("full"), _exact(F.col("capacity")))).over(family), F.lit(0)))
    shares = F.sum(F.when(~F.col("full"), _exact(F.col("weight")))).over(family)
    return (
        judged.withColumn("rest", rest).withColumn("shares", shares)
        .withColumn("allot", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("CAST(CAST(rest * weight AS DECIMAL(38,0)) div shares AS BIGINT)")))
        .drop("full", "rest", "shares")
    )


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Column], budget: Column, max_epochs: int) -> DataFrame:
    """Adds ``allot`` to ``leaves`` (the levels and ``tokens``): the tokens each leaf is to give.

    ``weights`` has the levels from the root down, each with its weight;
    ``budget`` is an expression over ``total``, the tokens of all leaves.
    """
    levels = list(weights)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).select(budget.cast("long").alias("budget"))
    above = total
    for depth, level in enumerate(levels):
        parents = levels[:depth]
        nodes = leaves.groupBy(*levels[: depth + 1]).agg((F.sum("tokens") * max_epochs).alias("capacity"))
        nodes = nodes.withColumn("weight", weights[level])
        nodes = nodes.join(above, parents) if parents else nodes.join(F.broadcast(above))
        above = deal_out(nodes, parents, level).select(*parents, level, F.col("allot").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "allot"), levels)


def _place(id_col: str, epoch: str) -> Column:
    """A document's place in the order of a leaf's epoch, as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.col(epoch), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def epochs_of_leaves(items: DataFrame, leaves: DataFrame, levels: Sequence[str]) -> DataFrame:
    """The levels, ``full`` epochs of all documents, and ``last``, the last place of one more epoch's prefix (or null).

    ``items`` has the levels, ``id`` and ``tokens``; ``leaves`` the levels,
    ``tokens``, ``docs`` and ``allot``. The order of a leaf is cut into cells
    in proportion to its documents; only the cell in which the budget ends is
    summed document by document.
    """
    plan = leaves.select(
        *levels, "allot",
        F.when(F.col("tokens") > 0, F.expr("allot div tokens")).otherwise(0).alias("full"),
        F.ceil(F.col("docs") / CELL_ROWS).alias("cells"),
        (F.col("allot") - F.when(F.col("tokens") > 0, F.expr("allot div tokens")).otherwise(0) * F.col("tokens")).alias("rest"),
    )
    placed = (
        items.join(plan.where("rest > 0"), levels)
        .withColumn("place", _place("id", "full"))
        .withColumn("cell", F.floor(F.conv(F.substring("place", 1, 13), 16, 10).cast("double") / 16**13 * F.col("cells")))
        .select(*levels, "rest", "cell", "place", "tokens")
    )
    by_cell = Window.partitionBy(*levels).orderBy("cell")
    # Written, or its partitioning by leaf would decide how the documents are dealt out below.
    ends = written(
        placed.groupBy(*levels, "rest", "cell").agg(F.sum("tokens").alias("cell_tokens"))
        .withColumn("upto", F.sum("cell_tokens").over(by_cell))
        .withColumn("before", F.col("upto") - F.col("cell_tokens"))
        .where("before < rest AND rest <= upto")
        .select(*levels, "cell", "before")
    )
    by_place = Window.partitionBy(*levels).orderBy("place")
    last = (
        placed.join(ends, [*levels, "cell"])
        .groupBy(*levels, "rest", "before", "place").agg(F.sum("tokens").alias("tokens"))
        .withColumn("upto", F.col("before") + F.sum("tokens").over(by_place))
        .where("upto - tokens < rest")
        .groupBy(*levels).agg(F.max("place").alias("last"))
    )
    return plan.select(*levels, "full").join(last, levels, "left")


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Column], budget: Column,
    max_epochs: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(row, epoch, the levels, n_tokens)``: the documents to train on, as often as an epoch takes them.

    ``row`` is the struct of the document's own columns. ``levels`` has an
    expression for each level of the tree from the root down, ``weights`` its
    weight. A leaf gives whole epochs of its documents and then a prefix of the
    next epoch in an order seeded by epoch and id: documents enter until the
    budget is used, so the last one may exceed it. Null levels are "(none)";
    null ids share one place, as do rows with the same id, and enter together;
    texts without words cost nothing and enter with their place. An empty table
    gives an empty table.
    """
    names = list(levels)
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
        *[F.coalesce(c, F.lit(NONE)).alias(n) for n, c in levels.items()], n_tokens(text_col).alias("tokens"),
    )
    items = written(wide.drop("row"))
    leaves = written(items.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    plan = written(epochs_of_leaves(items, leaf_budgets(leaves, weights, budget, max_epochs), names))
    times = F.col("full") + F.when(_place("id", "full") <= F.col("last"), 1).otherwise(0)
    return (
        wide.join(plan, names).withColumn("times", times.cast("int")).where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"), *names, F.col("tokens").alias("n_tokens"))
    )
