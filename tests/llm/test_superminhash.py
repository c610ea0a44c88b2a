import random

import numpy as np
import pytest

from freshet.llm import superminhash
from freshet.llm.queries import QUERIES
from freshet.llm.superminhash import REGISTERS, near_duplicates, shingle_set, signature

WORDS = [f"w{k}" for k in range(4000)]


def brute(rows):
    """``(id, n, component)`` from all pairs of exact shingle sets."""
    sets = []
    for _, text in rows:
        data = (text or "").encode().lower().split()
        sets.append({tuple(data[k : k + 5]) for k in range(max(1, len(data) - 4))} if data else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        known = [x for x in (least.get(find(k)), i) if x is not None]
        least[find(k)] = min(known) if known else None
    return sorted(((i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(rng, n, base_words, changes):
    base = rng.choices(WORDS, k=base_words)
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(40)]
    for size, words, changes in ((30, 200, 8), (12, 60, 2), (25, 400, 14), (6, 7, 1)):
        texts += near_copies(rng, size, words, changes)
    texts += ["", None, " \t\n", "One two", "one TWO", "two one", "a b c d e", "A b c d E", "x " * 3000] + texts[:5]
    rng.shuffle(texts)
    return list(enumerate(texts))


def found_in(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.id, r.n, r.component) for r in near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize("hubs, block", [(2, 128), (0, 3), (1, 5)])
def test_components_are_those_of_brute_force(spark, monkeypatch, hubs, block):
    monkeypatch.setattr(superminhash, "HUBS", hubs)
    monkeypatch.setattr(superminhash, "BLOCK", block)
    rows = corpus(hubs)
    assert found_in(spark, rows) == brute(rows)


def test_rows_without_id_repeated_rows_and_other_columns(spark):
    text = " ".join(WORDS[:100])
    rows = [(None, text), (None, text + " z"), (7, text), (7, text), (7, "other words"), (3, ""), (None, None), (9, "q " * 9), (None, "q " * 9)]
    assert found_in(spark, rows) == brute(rows)
    df = spark.createDataFrame([(1, text, "a", 2), (2, text, "b", 3)], "doc_id long, text string, set string, component long")
    assert {(r.id, r.component) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1)}
    assert found_in(spark, []) == [] and found_in(spark, [(None, None)]) == [(None, 0, None)]


def plain_signature(elements):
    """Element by element, each with a deck of its own."""
    mask = 2**64 - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    out = [mask] * REGISTERS
    for e in elements:
        deck = list(range(REGISTERS))
        for level in range(REGISTERS):
            bits = mixed(e + 0x9E3779B97F4A7C15 * (level + 1) & mask)
            k = level + ((bits & 0xFFFFFFFF) * (REGISTERS - level) >> 32)
            deck[level], deck[k] = deck[k], deck[level]
            out[deck[level]] = min(out[deck[level]], level << 32 | bits >> 32)
    return out


@pytest.mark.parametrize("size", [1, 3, 40, 500])
def test_early_stop_changes_no_register(size):
    elements = np.random.default_rng(size).integers(0, 2**63, size, np.uint64)
    assert signature(elements).tolist() == plain_signature(elements.tolist())


def test_registers_estimate_the_similarity_with_less_variance():
    rng, errors = np.random.default_rng(1), []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 60, np.uint64)
        a, b = signature(pool[:50]), signature(pool[10:])
        errors.append((a == b).mean() - 40 / 60)
    plain = (2 / 3) * (1 / 3) / REGISTERS  # of independent registers
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.8 * plain


def test_short_texts_are_one_shingle():
    assert len(shingle_set(b"a b")) == 1 and len(shingle_set(b"a b c d e")) == 1 and len(shingle_set(None)) == 0
    assert shingle_set(b"A\x0bb") == shingle_set(b" a b\n") and shingle_set(b"a b") != shingle_set(b"b a")


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op12_superminhash"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
