"""Quality rules: every rule is evaluated once; policies and ablations work on the failure bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import text_batches, text_bytes

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes that start no code point or are white space; what remains counts the code points of words.
_NOT_COUNTED = _SPACE + bytes(range(0x80, 0xC0))
REPEAT = 3


@dataclass(frozen=True)
class Measures:
    """What the rules look at; all are exact counts over the whole text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(words: list[bytes], size: int = REPEAT) -> int:
    """Words in windows of ``size`` words that are found twice or more."""
    windows = list(zip(*(words[k:] for k in range(size))))
    seen: set[tuple] = set()
    again: set[tuple] = set()
    if len(set(windows)) == len(windows):
        return 0
    for window in windows:
        (again if window in seen else seen).add(window)
    total, upto = 0, 0
    for k, window in enumerate(windows):
        if window in again:
            total += k + size - max(k, upto)
            upto = k + size
    return total


def measure(text: bytes | None) -> Measures:
    """A null text is measured as an empty one."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return Measures(
        n_words=len(words),
        word_chars=len(text.translate(None, _NOT_COUNTED)),
        n_symbols=len(text) - len(text.translate(None, _SYMBOLS)),
        n_lines=len(lines),
        n_dup_lines=len(lines) - len(set(lines)),
        n_repeat_words=repeated_words(words),
    )


#: The rules by bit, each true where a text fails; a bit keeps its meaning once given.
RULES: dict[str, Callable[[Measures], bool]] = {
    "few_words": lambda m: m.n_words < 50,
    "repeated_words": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: 2 * m.n_symbols > m.n_words,
    "repeated_lines": lambda m: 2 * m.n_dup_lines > m.n_lines,
    "short_words": lambda m: m.word_chars < 2 * m.n_words,
    "long_words": lambda m: m.word_chars > 15 * m.n_words,
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Which rules a version of the policy applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
_LEDGER = "id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, failed long"


def failure_bits(m: Measures) -> int:
    return sum(BIT[name] for name, fails in RULES.items() if fails(m))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _LEDGER.split(", ")]
    for batch in batches:
        found = [measure(text.as_py()) for text in batch.column(1)]
        columns = [pa.array([getattr(m, name) for m in found], pa.int64()) for name in names[1:-1]]
        bits = pa.array([failure_bits(m) for m in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, bits], names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, measures..., failed)`` of every row: what was measured and the bits of the rules it fails.

    Policies are applied to the ledger; no text is read again for them. Null
    texts count as empty, null ids stay null, repeated rows have a line each;
    ids must be numbers. An empty table gives no lines, and texts of any length
    are measured whole.
    """
    text_batches(docs.sparkSession)
    picked = docs.select(F.col(f"`{id_col}`").cast("long"), text_bytes(text_col))
    return picked.mapInArrow(_measured, _LEDGER)


def policy_mask(rules: tuple[str, ...]) -> int:
    return sum(BIT[name] for name in rules)


def fails(policy: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> Column:
    """Whether a line of the ledger fails a rule of the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy_mask(policies[policy]))) != 0


def ablations(book: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``(policy, rule, n_docs, n_dropped, n_without, n_only)`` for every policy and each of its rules.

    ``n_dropped`` rows fail the policy, ``n_without`` still fail it without
    the rule, and ``n_only`` fail nothing but the rule. The ledger is counted
    by its bits first, so at most 2^rules rows are left for the rest.
    """
    counted = book.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [(p, r, policy_mask(rules), BIT[r]) for p, rules in policies.items() for r in rules]
    cells = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"), F.lit(b).alias("bit")) for p, r, m, b in cases])
    hit = F.col("failed").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return (
        counted.select("failed", "n", F.explode(cells).alias("case")).select("failed", "n", "case.*")
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("n_docs"),
            total(hit != 0).alias("n_dropped"),
            total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) != 0).alias("n_without"),
            total(hit == F.col("bit")).alias("n_only"),
        )
    )
