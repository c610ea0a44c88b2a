"""Chat formatting: snapshots that longer logs contain are dropped, the rest is rendered.

A conversation that is logged again after each turn leaves snapshots, each a
prefix of the next. Every turn gets a rolling hash of all turns up to it; a
conversation whose last hash is found at the same place inside a longer one is
a prefix of it and goes. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import same, written

#: Turns whose numbers fall in one block of this size are ranked, and rendered, together.
BLOCK = 512
START, STOP = "<|im_start|>", "<|im_end|>"


def _hashes(role: Column, text: Column, *more: Column) -> list[Column]:
    """Two independent 64-bit hashes; null differs from empty."""
    parts = [*more, role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit(""))]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (0, 1)]


def _blocked(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / BLOCK), F.lit(-(2**62)))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, place, one, two)``: for each turn the rolling hash of the conversation up to it.

    ``turns`` has ``conv``, ``turn``, ``a`` and ``b`` (hashes of role and
    text). Repeated rows count once; turns are in the order of their numbers,
    null first, then of their hashes. The rolling hash is the exclusive-or of
    hashes of place and turn, so blocks of a long conversation are summed up on
    their own and only the blocks' results meet.
    """
    distinct = turns.distinct().withColumn("block", _blocked(F.col("turn")))
    in_block = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    ranked = written(distinct.withColumn("rank", F.row_number().over(in_block)))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranked.groupBy("conv", "block").agg(F.count("*").alias("n"))
    offsets = sizes.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = _join(ranked, offsets).withColumn("place", F.col("offset") + F.col("rank"))
    placed = placed.select("conv", "block", "place", F.xxhash64("place", "a", "b").alias("x"), F.xxhash64("b", "a", "place").alias("y"))
    upto = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.select("conv", "block", "place", F.bit_xor("x").over(upto).alias("x"), F.bit_xor("y").over(upto).alias("y"))
    whole = placed.groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = whole.select(
        "conv", "block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in "xy"]
    )
    rolled = _join(rolled, before)
    return rolled.select(
        "conv", "place", F.col("x").bitwiseXOR(F.col("x_before")).alias("one"), F.col("y").bitwiseXOR(F.col("y_before")).alias("two")
    )


def _join(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join per-block results to the rows of the block; conversations compare null-safely."""
    blocks = blocks.withColumnsRenamed({"conv": "conv_of", "block": "block_of"})
    return rows.join(blocks, same(F.col("conv"), F.col("conv_of")) & (F.col("block") == F.col("block_of"))).drop("conv_of", "block_of")


def maximal(prefixes: DataFrame) -> DataFrame:
    """``(conv, n_turns, n_logged)``: the conversations that no longer one starts with.

    Of equal conversations the smallest id stays (null last); ``n_logged``
    says how many there are. Equal conversations and equal prefixes are one row
    before the anti-join, so what many share is no hot key there.
    """
    last = prefixes.groupBy("conv").agg(F.max(F.struct("place", "one", "two")).alias("end")).select("conv", "end.*")
    ended = last.select(F.col("conv").alias("conv_of"), F.col("place").alias("length"))
    inner = prefixes.join(ended, same(F.col("conv"), F.col("conv_of"))).where("place < length")
    inner = inner.select("place", "one", "two").distinct()
    least = F.min(F.struct(F.col("conv").isNull().alias("unnamed"), "conv"))
    equal = last.groupBy("place", "one", "two").agg(least.alias("least"), F.count("*").alias("n_logged"))
    kept = equal.join(inner, ["place", "one", "two"], "left_anti")
    return kept.select(F.col("least.conv").alias("conv"), F.col("place").alias("n_turns"), "n_logged")


def rendered(role: Column, text: Column) -> Column:
    """One turn as text. Markers inside a text are broken by a space, so that they mark nothing."""
    safe = F.coalesce(text, F.lit(""))
    for marker in (START, STOP):
        safe = F.replace(safe, F.lit(marker), F.lit(marker.replace("<|", "< |")))
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), safe, F.lit(f"{STOP}\n"))


def format_chats(
    log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, part, n_turns, n_logged, chat)``: maximal conversations as chat text, one row each.

    Blocks of turn numbers are sorted and rendered on their own and joined in
    their order, so what a task sorts is a block, however long a conversation;
    ``part`` is 0. Null roles and texts are rendered as empty but differ from
    empty ones; rows without an id are one conversation, and turns without a
    number come first, as one block; repeated rows count once. An empty log
    gives an empty table. A conversation is one text, so it has to fit into a
    row, the one of the rows without an id too.
    """
    picked = log.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
        F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"),
    )
    a, b = _hashes(F.col("role"), F.col("text"))
    prefixes = written(turn_prefixes(picked.select("conv", "turn", a.alias("a"), b.alias("b"))))
    kept = written(maximal(prefixes)).withColumnRenamed("conv", "conv_of")
    turns = picked.join(kept, same(F.col("conv"), F.col("conv_of")))
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", *[h.alias(n) for h, n in zip(_hashes(F.col("role"), F.col("text")), "ab")], rendered(F.col("role"), F.col("text")).alias("said"))
    parts = turns.groupBy("conv", "n_turns", "n_logged", _blocked(F.col("turn")).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(order)), lambda t: t["said"]), "").alias("chat")
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "chat"))), lambda b: b["chat"]), "")
    chats = parts.groupBy("conv", "n_turns", "n_logged").agg(whole.alias("chat"))
    return chats.select("conv", F.lit(0).alias("part"), "n_turns", "n_logged", "chat")
