"""Phrase mining: counts of word sequences in a HAT-trie, spilled as sorted runs, merged and scored.

A task counts the windows of its texts in a burstable trie: the first word of
a window picks a subtree, whose container is one hash table of the words that
follow; a container that grows beyond ``BURST`` bursts into one container per
next word. Windows may end with their piece, and the counts of shorter phrases
are sums over subtrees: one insertion per word counts every phrase that starts
there. A trie that holds ``SPILL`` windows hands on its largest subtrees,
whole, as sorted runs of ``(lang, phrase, n)``, until half of them is left.

Runs are dealt by the hash of the phrase, so a frequent prefix is split over
all partitions, and merged there. A part of a phrase is never rarer than the
phrase, so words and pairs are counted first, and then only those longer
windows whose parts are all frequent: a bit filter of the frequent parts, of
bounded size, is asked. It lets through some that are not, whose counts then
tell; it never stops one that is.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.llm.common import text_batches, text_bytes, written

LONGEST, MIN_COUNT, TOP = 3, 10, 2000
#: A candidate goes if a longer phrase around it has this share of its count, in percent.
COVERED = 50
UNKNOWN = "und"
#: Windows in a container before it bursts, and in a trie before it spills.
BURST, SPILL = 2048, 1_500_000
#: Bits of the filter per frequent part, and of the whole filter at most (16 MB).
FILTER_BITS, MAX_FILTER = 16, 1 << 27
_RUN_ROWS, _BATCH_ROWS = 1 << 15, 300
#: Rows of a language are ranked in so many parts first.
_RANKED_PARTS = 32
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z in lower case, and one sign for all that end a piece.
_TABLE = bytes.maketrans(_UPPER + b",;:!?\n\x0b\x0c\r", _LOWER + b"." * 9)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_PROBES = 4


class _Ids(dict):
    """Words by their number; a new word gets the next one. Number 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.names = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text in lower case, with a full stop between pieces."""
    return (text or b"").translate(_TABLE).replace(b".", b" . ").split()


class _Node:
    """A burst container: one container per next word."""

    __slots__ = ("below",)

    def __init__(self) -> None:
        self.below: dict[int, dict | _Node] = {}


class _Pairs(dict):
    """Containers by first word."""

    def __missing__(self, first: int) -> dict[int, int]:
        self[first] = box = defaultdict(int)
        return box


class Trie:
    """Counts of windows of ``width`` words, two or more.

    Of a window of two, a container keeps the second word, else a tuple of the
    rest; only those can burst.
    """

    def __init__(self, width: int, burst: int = BURST):
        self.width, self.burst = width, burst
        self.roots: dict[int, dict | _Node] = _Pairs() if width == 2 else {}
        self.held: dict[int, int] = {}

    def add(self, ids: list[int]) -> None:
        """Count the windows that start at each word of a text, cut short by the end of its piece (0)."""
        if self.width == 2:
            roots = self.roots
            for first, second in zip(ids, ids[1:] + [0]):
                roots[first][second] += 1
            roots.pop(0, None)  # between pieces
            return
        padded, windows = ids + [0] * (self.width - 1), []
        for first, *rest in zip(*(padded[k:] for k in range(self.width))):
            if first:
                if 0 in rest:
                    k = rest.index(0)
                    rest[k:] = [0] * (len(rest) - k)
                windows.append((first, tuple(rest)))
        self.add_windows(windows)

    def add_windows(self, windows: Iterable[tuple[int, tuple[int, ...]]]) -> None:
        """Count windows of three words or more, given as the first word and the rest."""
        roots, held, burst, room = self.roots, self.held, self.burst, self.width - 2
        for first, rest in windows:
            box = roots.get(first)
            if box is None:
                roots[first] = {rest: 1}
                held[first] = 1
                continue
            depth, above = 0, None
            while type(box) is _Node:
                above, box = box, box.below.get(rest[depth])
                depth += 1
            if box is None:
                above.below[rest[depth - 1]] = {rest: 1}
            elif rest in box:
                box[rest] += 1
                continue
            else:
                box[rest] = 1
                if len(box) > burst and depth < room:
                    node = _Node()
                    for key, n in box.items():
                        node.below.setdefault(key[depth], {})[key] = n
                    if above is None:
                        roots[first] = node
                    else:
                        above.below[rest[depth - 1]] = node
            held[first] += 1

    def sizes(self) -> dict[int, int]:
        """Windows held under each first word."""
        return {first: len(box) for first, box in self.roots.items()} if self.width == 2 else dict(self.held)

    def take(self, first: int) -> Iterator[tuple[int | tuple[int, ...], int]]:
        """Remove the subtree of a word and give the rests of its windows with their counts."""
        self.held.pop(first, None)
        open_boxes = [self.roots.pop(first)]
        while open_boxes:
            box = open_boxes.pop()
            if type(box) is _Node:
                open_boxes.extend(box.below.values())
            else:
                yield from box.items()

    def run(self, first: int, names: list[bytes], shortest: int = 1) -> tuple[list[bytes], list[int]]:
        """Remove the subtree of a word as a sorted run: its phrases of ``shortest`` words or more, and their counts."""
        if self.width == 2:
            box = self.roots.pop(first)
            total = sum(box.values())
            box.pop(0, None)
            order, prefix = sorted(box, key=names.__getitem__), names[first] + b" "
            phrases, counts = [prefix + names[w] for w in order], [box[w] for w in order]
            return ([names[first], *phrases], [total, *counts]) if shortest == 1 else (phrases, counts)
        if shortest == self.width:
            found = sorted((b" ".join([names[first], *[names[i] for i in rest]]), n) for rest, n in self.take(first))
        else:
            sums: dict[tuple[int, ...], int] = {}
            for rest, n in self.take(first):
                window = (first, *rest)
                for k in range(shortest, self.width + 1):
                    if not window[k - 1]:
                        break
                    sums[window[:k]] = sums.get(window[:k], 0) + n
            found = sorted((b" ".join([names[i] for i in phrase]), n) for phrase, n in sums.items())
        return [phrase for phrase, _ in found], [n for _, n in found]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, width: int, lang: str) -> np.ndarray:
    """A hash of each ``width`` consecutive words, given by their hashes, in a language."""
    found = np.full(max(len(words) - width + 1, 0), xxhash.xxh3_64_intdigest(lang.encode()), np.uint64)
    for k in range(width):
        found = _mixed(found * _GOLD + words[k : k + len(found)])
    return found


def _places(grams: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash in a filter of ``bits``, a power of two."""
    step = _mixed(grams * _GOLD) | np.uint64(1)
    return (grams[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)) & np.uint64(bits - 1)


def _held(held: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether a filter has all bits of each hash."""
    places = _places(grams, 8 * len(held))
    return (held[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool).all(axis=1)


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))


def part_filter(frequent: DataFrame, width: int) -> np.ndarray:
    """The bits of all phrases of ``width`` words of ``(lang, phrase)``; at most ``MAX_FILTER`` of them, whatever their number."""
    keyed = frequent.where(F.size(F.split("phrase", " ")) == width).select("lang", F.col("phrase").cast("binary").alias("phrase"))
    wanted = max(keyed.count() * FILTER_BITS, 1 << 12)
    bits = min(1 << (wanted - 1).bit_length(), MAX_FILTER)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [
                gram_hashes(_hashes(phrase.split(b" ")), width, lang)
                for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            places = np.unique(_places(np.concatenate(grams), bits)) if grams else np.zeros(0, np.uint64)
            words = (places >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["word", "bits"]
            )

    merged = keyed.mapInArrow(partition, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = np.zeros(bits // 64, np.int64)
    table = merged.toArrow()  # MAX_FILTER / 64 rows at most
    held[table["word"].to_numpy()] = table["bits"].to_numpy()
    return held.view(np.uint8)


def _windows(ids: np.ndarray, known: np.ndarray, width: int, lang: str, held: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """The windows of ``width`` words, of numbers ``ids`` and hashes ``known``, whose parts of one word less the filter has."""
    if len(ids) < width:
        return []
    whole = np.lib.stride_tricks.sliding_window_view(ids, width - 1).all(axis=1)
    at = np.flatnonzero(whole)
    whole[at] = _held(held, gram_hashes(known, width - 1, lang)[at])
    at = np.flatnonzero(whole[:-1] & whole[1:])
    columns = [ids[at + k].tolist() for k in range(width)]
    return list(zip(columns[0], zip(*columns[1:])))


def _counted(width: int, shortest: int, burst: int, spill: int, parts=None):
    """The task: batches of ``(lang, text)`` to runs.

    Without ``parts``, all windows count, and the empty phrase counts the
    words of a language; with the broadcast filter of the phrases one shorter,
    only whole windows whose parts it has.
    """

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashed = _Ids(), np.zeros(0, np.uint64)
        tries: dict[str, Trie] = {}
        totals: dict[str, int] = {}

        def runs(share: float) -> Iterator[pa.RecordBatch]:
            """Hand on the largest subtrees, until ``share`` of each language's windows is left."""
            for lang, trie in tries.items():
                sizes = trie.sizes()
                left = sum(sizes.values())
                down_to = left * share
                phrases, counts = [], []
                for first in sorted(sizes, key=sizes.__getitem__, reverse=True):
                    if left <= down_to:
                        break
                    left -= sizes[first]
                    run = trie.run(first, ids.names, shortest)
                    phrases += run[0]
                    counts += run[1]
                    if len(phrases) >= _RUN_ROWS:
                        yield _batch(lang, phrases, counts)
                        phrases, counts = [], []
                yield _batch(lang, phrases, counts)

        gc.disable()  # millions of small objects, no cycle among them
        try:
            for batch in batches:
                together: dict[str, list[int]] = defaultdict(list)
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    together[lang] += map(ids.__getitem__, tokens(text.as_py()))
                    together[lang].append(0)
                for lang, numbers in together.items():
                    trie = tries.get(lang)
                    if trie is None:
                        trie = tries[lang] = Trie(width, burst)
                    if parts is None:
                        trie.add(numbers)
                        totals[lang] = totals.get(lang, 0) + len(numbers) - numbers.count(0)
                        continue
                    if len(hashed) < len(ids.names):
                        hashed = np.concatenate([hashed, _hashes(ids.names[len(hashed) :])])
                    arr = np.array(numbers, np.int64)
                    trie.add_windows(_windows(arr, hashed[arr], width, lang, parts.value))
                if sum(sum(t.sizes().values()) for t in tries.values()) > spill:
                    yield from runs(0.5)
                if len(ids.names) > spill:  # words that are gone go too
                    yield from runs(0)
                    ids, hashed = _Ids(), hashed[:0]
            yield from runs(0)
            for lang, n in totals.items():
                yield _batch(lang, [b""] * (n > 0), [n] * (n > 0))
        finally:
            gc.enable()

    return partition


def _batch(lang: str, phrases: list[bytes], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"]
    )


def _merged(docs: DataFrame, counted, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, phrase, n)`` from the runs of a task function."""
    text_batches(docs.sparkSession, _BATCH_ROWS)
    picked = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit(UNKNOWN)).alias("lang"), text_bytes(text_col).alias("text"))
    runs = picked.mapInArrow(counted, "lang string, phrase binary, n long")
    # runs are counted already: they are merged where they arrive, not once more before
    merged = runs.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return merged.select("lang", F.col("phrase").cast("string").alias("phrase"), "n")


def phrase_counts(
    docs: DataFrame, longest: int = 2, text_col: str = "text", lang_col: str = "lang", burst: int = BURST, spill: int = SPILL
) -> DataFrame:
    """``(lang, phrase, n)`` of every phrase of up to ``longest`` words; the empty phrase has the language's words.

    Each row's text counts, repeated rows too. A null language is ``und``, a
    null or empty text has no phrase; an empty table gives no rows. A text of
    any length is counted whole.
    """
    return _merged(docs, _counted(longest, 1, burst, spill), text_col, lang_col)


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, text_col: str = "text", lang_col: str = "lang", burst: int = BURST, spill: int = SPILL
) -> DataFrame:
    """The rows of :func:`phrase_counts` with a count of ``min_count`` or more, and the empty phrase of every language.

    One pass counts words and pairs, one more each longer size.
    """
    first = written(phrase_counts(docs, 2, text_col, lang_col, burst, spill).where((F.col("n") >= min_count) | (F.col("phrase") == "")))
    found, context = [first], docs.sparkSession.sparkContext
    for width in range(3, longest + 1):
        parts = context.broadcast(part_filter(found[-1], width - 1))
        counts = _merged(docs, _counted(width, width, burst, spill, parts), text_col, lang_col)
        found.append(written(counts.where(F.col("n") >= min_count)))
    return reduce(DataFrame.unionAll, found)


def _parts(longest: int) -> Column:
    """The two parts of every cut of ``words``, as ``(k, left, right)``."""

    def part(k: int) -> Column:
        return F.struct(
            F.lit(k).alias("k"), F.concat_ws(" ", F.slice("words", 1, k)).alias("left"),
            F.concat_ws(" ", F.slice("words", F.lit(k + 1), F.col("size") - k)).alias("right"),
        )

    return F.array_compact(F.array(*[F.when(F.col("size") > k, part(k)) for k in range(1, longest)]))


def _inside() -> Column:
    """The phrases of two words or more inside ``words``, itself left out."""
    spans = F.expr(
        "flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), k -> concat_ws(' ', slice(words, k, w)))))"
    )
    return F.when(F.col("size") > 2, F.array_distinct(spans))


def collocations(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED,
    text_col: str = "text", lang_col: str = "lang", burst: int = BURST, spill: int = SPILL,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two words or more in each language.

    A phrase with count ``a`` scores ``1000000 * a * a / (l * r)``, rounded
    down, at its weakest cut into parts with counts ``l`` and ``r``, the first
    such cut on a tie. Phrases inside a longer one that has ``covered``
    percent of their count are left out. Ties are ranked by count, then by the
    bytes of the phrase. Products have 38 digits.
    """
    frequent = frequent_phrases(docs, longest, min_count, text_col, lang_col, burst, spill)
    totals = frequent.where("phrase = ''").select("lang", "n")
    known = frequent.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"))
    phrases = known.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")).where("size > 1")
    longer = (
        phrases.select("lang", F.explode(_inside()).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    )
    left = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    score = F.expr("(1000000 * CAST(a AS DECIMAL(20,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    cuts = (
        phrases.select("lang", "phrase", "a", F.explode(_parts(longest)).alias("cut"))
        .select("lang", "phrase", "a", "cut.*")
        .join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .withColumn("score", score)
    )
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = (
        weakest.join(longer, ["lang", "phrase"], "left")
        .where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("a")))
        .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    )
    # the best of each part of a language are ranked once more, so no task gets more rows than parts times top
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_RANKED_PARTS)).alias("part")
    in_part = kept.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = in_part.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = best.where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
