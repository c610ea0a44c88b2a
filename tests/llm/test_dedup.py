"""Exact, line, substring and near dedup against brute force, with awkward inputs."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import components, exact_dedup, line_dedup, simhash, substring_dedup
from freshet.llm.common import shared_folder, written
from corpus_brute import brute_classes, brute_fingerprint, brute_lines, brute_substrings

SCHEMA = "doc_id long, text string, id string, key string, kept int, made int, drop_id int, kept_id int, fp int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def awkward(seed=0):
    """Copies, near copies, shared passages and lines, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["The", "é", "漢字"]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    line = "A line that Many documents share."
    rows, base = [], [" ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 120))) for _ in range(12)]
    for k in range(70):
        words = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 3])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        text = " ".join(words)
        if k % 3 == 0:
            text = f"{text}\n{passage} end{k}"
        if k % 4 == 0:
            text = f"  {line.upper()}\t\n{text}\n{line}\n\nshort\nshort"
        rows.append((k * 7 % 71, text))
    rows += [(100, None), (101, ""), (102, ""), (103, " \t\x0b"), (104, "one"), (105, "One two"), (106, "é" * 9), (107, "é" * 9)]
    rows += [(108, f"{passage} " * 300), (109, "x" * 50_000), rows[0], rows[0], (None, base[0]), (None, "no id")]
    return rows


def test_exact(spark):
    rows = [(i, (t or "").swapcase() if i % 2 else t) for i, t in awkward() if i is not None] + [(None, "one"), (None, "Q"), (None, "q")]
    classes = defaultdict(list)
    for i, t in rows:
        classes[(t or "").encode().lower()].append(-1 if i is None else i)
    found = exact_dedup.exact_duplicates(frame(spark, rows), capacity=2000).collect()
    assert len(found) == len(rows)
    by_digest = {hashlib.sha256(t).digest(): ids for t, ids in classes.items()}
    for digest, ids in by_digest.items():
        mine = [r for r in found if bytes(r["sha256"]) == digest]
        assert sorted(-1 if r["id"] is None else r["id"] for r in mine) == sorted(ids)
        assert {r["n"] for r in mine} == {len(ids)}
        assert {-1 if r["keep_id"] is None else r["keep_id"] for r in mine} == {max(ids)}
        kept = [r for r in mine if r["kept"]]
        assert len(kept) == 1 and kept[0]["id"] == kept[0]["keep_id"]
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []


def test_exact_directory_doubles():
    sizes = {k: 10 for k in range(0, 1 << 16, 1 << 10)}
    parts = exact_dedup.directory_for(sizes, 40)
    assert sum(parts.values()) == 640 and max(parts.values()) <= 40
    assert sum(2.0 ** -len(p) for p in parts) == 1  # every hash has one bucket
    assert exact_dedup.directory_for({5: 1000}, 40)["0000000000000101"] == 1000  # one hash cannot be split
    assert exact_dedup.directory_for({}, 40) == {"": 0}


def test_exact_index_grows_batch_by_batch(spark):
    rows = [(i, f"text {i % 17} " + "y" * (i % 17)) for i in range(120)]
    folder = shared_folder(spark)
    for k in range(3):
        index = exact_dedup.ExactIndex(spark, folder, 60) if k == 0 else exact_dedup.ExactIndex.open(spark, folder, 60)
        batch = frame(spark, rows[40 * k : 40 * k + 40])
        index.insert(batch, written(exact_dedup.signatures(batch)))
    found = {bytes(r["text"]).decode(): (r["keep_id"], r["n"]) for r in index.entries().collect()}
    expected = defaultdict(lambda: [0, 0])
    for i, t in rows:
        expected[t] = [max(expected[t][0], i), expected[t][1] + 1]
    assert found == {t: tuple(v) for t, v in expected.items()}
    assert len(index.directory) > 4


def test_exact_chains_collisions(monkeypatch):
    """Texts with one hash stay apart."""
    import pyarrow as pa

    entries = [(7, b"a", 0, 1, 1), (7, b"b", 0, 2, 1), (7, b"a", 0, 9, 2), (8, b"c", 0, 3, 1)]
    out = list(exact_dedup._owned(["b"], [-(2**63)])([exact_dedup._batch(entries, ["b"], [-(2**63)])]))
    merged = pa.Table.from_batches(out).select(["hash", "text", "chain", "keep_id", "n"]).to_pylist()
    assert [tuple(m.values()) for m in merged] == [(7, b"a", 0, 9, 3), (7, b"b", 1, 2, 1), (8, b"c", 0, 3, 1)]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2)])
def test_lines(spark, batches, fanout):
    rows = awkward(1)
    docs = frame(spark, rows)
    found = line_dedup.drop_repeated_lines(docs, stats="stats", batches=batches, fanout=fanout)
    assert found.columns == [*docs.columns, "stats"]
    got = sorted((2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["stats"]["n_lines"], r["stats"]["n_dropped"]) for r in found.collect())
    assert got == brute_lines(rows)
    assert sum(g[3] for g in got) > 10


def test_lines_of_nothing(spark):
    docs = frame(spark, [])
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns
    assert line_dedup.drop_repeated_lines(docs).collect() == []


def test_line_index_is_kept_between_sessions(spark):
    folder = shared_folder(spark)
    batches = [[(b"a", 1), (b"b", 1)], [(b"b", 5), (b"c", 6)], [(b"a", 7), (b"d", 8)], [(b"e", 9)]]
    for k, batch in enumerate(batches):
        index = line_dedup.LineIndex(spark, folder, 2, 3) if k == 0 else line_dedup.LineIndex.open(spark, folder, 2)
        found = index.add(spark.createDataFrame(batch, "key binary, owner long"))
        if k == 1:
            assert {(bytes(r["key"]), r["seen"]) for r in found.collect()} == {(b"b", 1), (b"c", None)}
    assert {(bytes(r["key"]), r["owner"]) for r in index.owners().collect()} == {(b"a", 1), (b"b", 1), (b"c", 6), (b"d", 8), (b"e", 9)}
    assert [len(runs) for runs in index.levels] == [0, 0, 1]


def test_substrings(spark):
    rows = awkward(2)
    found = substring_dedup.cut_repeats(frame(spark, rows)).collect()
    got = sorted((2**63 - 1 if r["id"] is None else r["id"], r["text"], r["n_words"], r["n_removed"]) for r in found)
    assert got == brute_substrings(rows)
    for r in found:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        assert all(s["stop"] - s["start"] >= 13 for s in r["spans"])
    assert substring_dedup.cut_repeats(frame(spark, [])).collect() == []


def test_every_window_has_an_anchor_of_its_own_words():
    r = np.random.default_rng(0)
    words = r.integers(0, 2**63, 200).astype(np.uint64)
    anchors = substring_dedup.window_anchors(words)
    for k in range(len(words) - 12):
        assert anchors[k] == substring_dedup.gram_hashes(words[k : k + 13], substring_dedup.GRAM).min()
    assert len(substring_dedup.window_anchors(words[:12])) == 0


def test_fingerprints_are_those_of_the_sql_function(spark):
    rows = awkward(3)
    found = simhash.fingerprints(frame(spark, rows)).collect()
    expected = sorted(brute_fingerprint((t or "").encode()) for _, t in rows)
    assert sorted(r["fp"] % 2**64 for r in found) == expected
    one = spark.createDataFrame([("é w a",)], "s string").select(F.xxhash64("s")).first()[0]
    assert brute_fingerprint("É w A".replace("É", "é").encode()) == one % 2**64


def test_near_duplicates(spark):
    rows = awkward(4)
    rows += [(1000 + k, rows[2][1].replace(" ", "  ", k)) for k in range(40)]  # a group of copies
    fps = {i: brute_fingerprint((t or "").encode()) for i, t in rows if i is not None}
    cls = brute_classes({brute_fingerprint((t or "").encode()) for _, t in rows})
    least = {}
    for i, f in fps.items():
        least[cls[f]] = min(least.get(cls[f], i), i)
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["component"] == least.get(cls[r["fp"] % 2**64])
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 2
    assert simhash.near_duplicates(frame(spark, [])).collect() == [] == simhash.keep_one(frame(spark, [])).collect()


def test_links_reach_what_all_pairs_reach(spark):
    r = random.Random(5)
    fps = set()
    for size in (1, 2, 40, 250):
        center = r.getrandbits(64)
        for _ in range(size):
            f = center
            for _ in range(r.randrange(4)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    frame_ = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    linked = simhash.links(frame_)
    assert all((a ^ b).bit_count() <= 2 for a, b in ((r["fp"] % 2**64, r["hub"] % 2**64) for r in linked.collect()))
    root = {r["a"] % 2**64: r["b"] % 2**64 for r in components.connected(linked).collect()}
    groups, expected = defaultdict(set), defaultdict(set)
    for f, c in brute_classes(fps).items():
        groups[root.get(f, f)].add(f)
        expected[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r["a"]: r["b"] for r in components.connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 150)}, 201: 200}
