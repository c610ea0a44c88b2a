"""Substring dedup of rows that have no id, or the same id and different texts."""

import pytest

from corpus_brute import brute_substrings
from freshet.llm import substring_dedup


@pytest.mark.parametrize("i", [None, 7])
def test_rows_are_cut_by_their_own_repeats(spark, i):
    words = [f"w{k}" for k in range(200)]
    passage = " ".join(words[:20])
    rows = [(1, passage), (i, f"{passage} " + " ".join(words[30:50])), (i, " ".join(words[60:90])), (i, " ".join(words[100:120]) + f" {passage}")]
    rows += [rows[1], (i, " ".join(words[120:150])), (i, " ".join(words[120:150]) + " end"), (i, None), (2, "short")]
    found = substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((2**63 - 1 if r["id"] is None else r["id"], r["text"], r["n_words"], r["n_removed"]) for r in found)
    assert got == brute_substrings(rows)
    assert (i or 2**63 - 1, " ".join(words[60:90]), 30, 0) in got
