"""The corpus pipeline: stages over ``documents``, each the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import language, line_dedup, pieces, simhash
from freshet.llm.common import table, written
from freshet.llm.queries import mixed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; ``lang`` is then the told one."""
    return language.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has too go; ``n_chars`` counts what is left."""
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights have room for stay, each once at most."""
    return mixed(docs, max_epochs=1).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the text that they decode to."""
    encoded, _ = pieces.codec_columns(docs, pieces.load())
    coded = docs.select("doc_id", "lang", "source", encoded().alias("coded"))
    return coded.select(
        "doc_id", "lang", "source", F.size("coded.ids").cast("long").alias("n_ids"), "coded.ids",
        F.sha2("coded.back", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("sentencepiece", tokenize),
]

#: Classifier and tokenizer stages have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
