"""Near duplicates by SuperMinHash: signatures, banding, verification, union of what is verified.

Two documents link if their sets of lower-cased ``SHINGLE``-word shingles have
a Jaccard similarity of ``PERCENT`` or more. A SuperMinHash signature (Ertl
2017) deals each element one rank per register, all different, instead of one
independent hash per register; registers of one document are negatively
correlated, which lowers the variance of the similarity they estimate. Element
ranks are dealt level by level, and a level is dealt only while some register
is still above it, so a long text needs one level.

Sets that agree in a band of registers are candidates. A pair at similarity s
shares one of ``BANDS`` bands of ``ROWS`` with a probability of
1 - (1 - s^ROWS)^BANDS: 0.999996 at 0.85, more above. Which candidates link is
decided on the whole sets, in three steps that never list the pairs of a band:
all members against one hub, the same with another hub for what is still apart,
then a grid of small blocks for what is apart even then.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import same, text_batches, text_bytes, written
from freshet.llm.components import connected

SHINGLE = 5
PERCENT = 85
ROWS, BANDS = 7, 32
REGISTERS = ROWS * BANDS
#: Bands are compared in so many rounds, so that one round's shuffle is on disk at a time.
ROUNDS = 2
HUBS = 2
#: Sets on a side of a block of the grid.
BLOCK = 128
BATCH_ROWS = 500
_CHUNK = 1 << 16
_CACHED = 1 << 17
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)
_words: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles; fewer words than a shingle has are one, no words none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > _CACHED:
        _words.clear()
    for word in words:
        if word not in _words:
            _words[word] = xxhash.xxh3_64_intdigest(word)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    found = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        found = _mixed(found * _GOLD + hashes[k : k + len(found)])
    return np.unique(found)


def signature(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes: level and rank of the least element dealt to each."""
    m, n = REGISTERS, len(elements)
    registers = np.full(m, 2**64 - 1, np.uint64)
    deck = last = each = None
    for level in range(m):
        if level and registers.max() < np.uint64(level << 32):
            break  # what is still to come is above every register
        if level == 1:
            deck, each = np.tile(np.arange(m, dtype=np.uint16), (n, 1)), np.arange(n)
            deck[each, last] = 0
        drawn = np.empty(n, np.int64)
        for k in range(0, n, _CHUNK):
            part = slice(k, k + _CHUNK)
            bits = _mixed(elements[part] + np.uint64(int(_GOLD) * (level + 1) % 2**64))
            drawn[part] = level + ((bits & _LOW) * np.uint64(m - level) >> _HALF).astype(np.int64)
            to = drawn[part] if level == 0 else deck[each[part], drawn[part]]
            np.minimum.at(registers, to, np.uint64(level << 32) | bits >> _HALF)
        if level:
            deck[each, drawn] = deck[:, level]
        last = drawn
    return registers


def band_keys(elements: np.ndarray) -> np.ndarray:
    """One hash per band of the signature; none for the empty set."""
    if not len(elements):
        return elements
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in signature(elements).reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _GOLD + row)
    return keys


def digest(elements: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for the empty one."""
    return xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None


def alike(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``a`` and ``b`` elements with ``shared`` in common link."""
    return 100 * shared >= PERCENT * (a + b - shared)


_SKETCH = T.StructType([
    T.StructField("set", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
])
_SET = T.StructType([T.StructField("set", T.BinaryType()), T.StructField("shingles", T.BinaryType())])


@F.arrow_udf(_SKETCH)
def _sketch(texts: pa.Array) -> pa.Array:
    names, sizes, keys = [], [], []
    for text in texts:
        elements = shingle_set(text.as_py())
        names.append(digest(elements))
        sizes.append(len(elements))
        keys.append(band_keys(elements).view(np.int64))
    arrays = [pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
    return pa.StructArray.from_arrays(arrays, ["set", "n", "keys"])


@F.arrow_udf(_SET)
def _shingled(texts: pa.Array) -> pa.Array:
    sets = [shingle_set(t.as_py()) for t in texts]
    arrays = [pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
    return pa.StructArray.from_arrays(arrays, ["set", "shingles"])


def _elements(shingles: object) -> np.ndarray:
    return np.frombuffer(shingles.as_buffer(), np.uint64)


@F.arrow_udf(T.BooleanType())
def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    found = []
    for x, y in zip(map(_elements, a), map(_elements, b)):
        found.append(bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
    return pa.array(found)


def may_link(n: str, m: str) -> F.Column:
    """Sizes that allow the similarity."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def shared_bands(distinct: DataFrame) -> DataFrame:
    """``(key, set, n)``: the members of each band key that two sets or more have."""
    found, width = [], BANDS // ROUNDS
    for k in range(ROUNDS):
        keys = distinct.select("set", "n", F.explode(F.slice("keys", k * width + 1, width)).alias("key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
        found.append(written(keys.join(shared, "key").select("key", "set", "n")))
    return reduce(DataFrame.unionAll, found)


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with ``root``, of the keys that still span several components.

    Keys with the same members are one: only the least of them is kept.
    """
    rooted = members.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    spans = rooted.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"),
        F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("mark"), F.bit_xor(F.xxhash64(F.col("set"), F.lit(1))).alias("mark2"),
    )
    split = spans.where("lo <> hi").groupBy("members", "mark", "mark2").agg(F.min("key").alias("key")).select("key", "members")
    return written(rooted.join(split, "key"))


def _hub_pairs(apart: DataFrame, order: int) -> DataFrame:
    """``(set, hub)``: each member and the hub of its key, the first set by a hash, where they are apart and may link."""
    hubs = apart.groupBy("key").agg(
        F.min(F.struct(F.xxhash64(F.col("set"), F.lit(order)).alias("place"), "set", "n", "root")).alias("hub")
    )
    pairs = apart.join(hubs, "key").where((F.col("root") != F.col("hub.root")) & may_link("n", "hub.n"))
    return pairs.select("set", F.col("hub.set").alias("hub")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets link."""
    of_hub = sets.select(F.col("set").alias("hub"), F.col("shingles").alias("hub_shingles"))
    return pairs.join(sets, "set").join(of_hub, "hub").where(_linked("shingles", "hub_shingles")).select("set", "hub")


def block_links(cell: pa.Table) -> pa.Table:
    """Links of one block: each outsider (``side`` 1) against the members (``side`` 0) that are apart from it.

    The members' elements are one sorted list with their owners, in which the
    elements of an outsider are looked up. One link per outsider and component
    is enough.
    """
    side = cell["side"].to_numpy()
    names, roots = cell["set"].to_pylist(), cell["root"].to_pylist()
    elements = [_elements(s) for s in cell["shingles"]]
    inner, outer = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    owners = np.repeat(np.arange(len(inner)), [len(elements[i]) for i in inner])
    pool = np.concatenate([elements[i] for i in inner] or [np.zeros(0, np.uint64)])
    order = np.argsort(pool, kind="stable")
    pool, owners = pool[order], owners[order]
    sizes = np.array([len(elements[i]) for i in inner], np.int64)
    found = []
    for o in outer:
        lo, hi = np.searchsorted(pool, elements[o], "left"), np.searchsorted(pool, elements[o], "right")
        hits = hi - lo
        at = np.repeat(lo - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        shared = np.bincount(owners[at], minlength=len(inner))
        seen = {roots[o]}
        for i in np.flatnonzero(alike(shared, sizes, len(elements[o]))):
            if roots[inner[i]] not in seen:
                seen.add(roots[inner[i]])
                found.append((names[o], names[inner[i]]))
    return pa.table({"set": pa.array([f[0] for f in found], pa.binary()), "hub": pa.array([f[1] for f in found], pa.binary())})


def _grid_links(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components within a key, checked block by block.

    Outsiders, the members not of a key's largest component, meet all members;
    both are dealt into blocks by a hash, so that no task holds more than two
    blocks however many members a key has.
    """
    counts = apart.groupBy("key", "root").agg(F.count("*").alias("of_root"), F.max("members").alias("members"))
    major = counts.groupBy("key").agg(
        F.max(F.struct("of_root", "root")).alias("major"),
        F.ceil(F.max("members") / BLOCK).alias("across"),
        F.ceil((F.max("members") - F.max("of_root")) / BLOCK).alias("down"),
    )
    dealt = apart.join(major, "key")

    def place(blocks: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col("set"), F.lit(7)), F.col(blocks))

    each = [("across", "down", F.lit(True)), ("down", "across", F.col("root") != F.col("major.root"))]
    sides = [
        dealt.where(which).select(
            "key", "set", "root", F.lit(side).alias("side"), place(own).alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        ).select("key", "set", "root", "side", "across", "down")
        for side, (own, other, which) in enumerate(each)
    ]
    cells = sides[0].unionAll(sides[1]).join(sets, "set")
    return cells.groupBy("key", "across", "down").applyInArrow(block_links, "set binary, hub binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, component)`` of every row: the size of its set and the smallest id that links reach.

    Null and empty texts, and those without a word, have no set and link with
    nothing: their component is their own id. A null id never names a
    component, unless all ids of it are null. Repeated rows come back as often
    as they are given; equal sets meet before the search. An empty table gives
    no rows. Texts of any length are read whole.
    """
    text_batches(docs.sparkSession, BATCH_ROWS)
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("text"))
    rows = written(picked.select("id", _sketch("text").alias("sketch")).select("id", "sketch.*"))
    distinct = written(
        rows.where("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    members = shared_bands(distinct)
    # A set's text is that of its smallest id; what else has this id is told apart by the digest.
    named = members.select("set").distinct()
    holders = distinct.join(named, "set").select("set", F.col("least").alias("holder"))
    held = picked.join(holders.select("holder").distinct(), same(F.col("id"), F.col("holder")), "left_semi")
    shingled = held.select(_shingled.asNondeterministic()("text").alias("found")).select("found.*")
    sets = written(shingled.join(named, "set", "left_semi").dropDuplicates(["set"]))

    roots = distinct.select("set", F.col("set").alias("root")).limit(0)
    for step in range(HUBS + 1):
        apart = _apart(members, roots)
        if apart.isEmpty():
            break
        new = _verified(_hub_pairs(apart, step), sets) if step < HUBS else _grid_links(apart, sets)
        roots = connected(written(new).unionAll(roots)).toDF("set", "root")
    label = distinct.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = label.groupBy("root").agg(F.min("least").alias("component"))
    label = label.join(least, "root").select("set", "component")
    linked = rows.join(label, "set").select("id", "n", "component")
    return linked.unionAll(rows.where("set IS NULL").select("id", "n", F.col("id").alias("component")))
