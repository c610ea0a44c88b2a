"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the smallest node of the neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    below = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return below.union(least.select("a", F.col("least").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``(a, b)``: every node that is not the smallest of its component, and that smallest node.

    ``edges`` has two columns of one orderable type; self-loops, repeats and
    either direction are fine, rows with a null are ignored. Each round joins
    nodes to the minimum of their neighbours and is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path.
    Nothing but a checksum comes to the driver. No edges give no rows.
    """
    first, second = (F.col(f"`{c}`") for c in edges.columns)
    edges = written(
        edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
        .where(first.isNotNull() & second.isNotNull() & (first != second))
        .distinct()
    )
    seen = None
    while True:
        total = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if total == seen or not total[0]:
            return edges
        seen = total
        edges = written(_small_star(_large_star(edges).distinct()))
