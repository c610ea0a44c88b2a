"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed to ``FEATURES`` columns; the
document frequencies cover all documents that may be learned from. The
regression is fitted by follow-the-regularised-leader with an elastic net on a
sample of at most about ``TRAIN_PER_CLASS`` documents a language, in shards
whose weights are averaged, and its scores are calibrated by a temperature on
other documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm.common import text_batches, text_bytes, unused, written

BITS = 14
FEATURES = 1 << BITS
UNKNOWN = "und"
#: Documents a language, for the weights and for the temperature.
TRAIN_PER_CLASS, CALIBRATE_PER_CLASS = 3000, 1000
SHARDS, EPOCHS = 4, 4
ALPHA, BETA, L1, L2 = 1.0, 0.1, 2e-3, 1e-4
TEMPERATURES = [round(1.15**k, 4) for k in range(-10, 21)]
#: Documents that score less are rejected by the filter.
MIN_SCORE = 0.4

_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
_STEP, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def term_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of the lower-cased whole text and how often each occurs; None without a letter.

    What is no letter counts as a space.
    """
    points = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    letter = _LETTER[points]
    if not letter.any():
        return None
    one = np.concatenate(([np.uint32(32)], np.where(letter, points, np.uint32(32)), [np.uint32(32)]))
    two = one[:-1] * _STEP + one[1:]
    three = two[:-1] * _STEP + one[2:]
    grams = np.concatenate((one, two + np.uint32(1 << 30), three + np.uint32(1 << 31)))
    grams ^= grams >> np.uint32(15)
    counts = np.bincount(grams * _MIX >> np.uint32(32 - BITS), minlength=FEATURES)
    terms = counts.nonzero()[0]
    return terms, counts[terms]


def _tf_idf(text: bytes | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    found = term_counts(text)
    if found is None:
        return None
    terms, counts = found
    values = (1 + np.log(counts)) * idf[terms]
    norm = np.sqrt(values @ values)
    return terms, values / norm if norm else values


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for text in batch.column(0):
            found = term_counts(text.as_py())
            if found is not None:
                total[found[0]] += 1
                total[FEATURES] += 1
    kept = total.nonzero()[0]
    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], ["term", "n"])


def fit_shard(labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights (term x class, the last row is the intercept) after ``EPOCHS`` passes over the rows."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for label, (terms, values) in zip(labels, rows):
            at, x = np.append(terms, FEATURES), np.append(values, 1.0)
            w = weights(at)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(slice(None))


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max())
    return e / e.sum()


@dataclass
class Model:
    """Everything a prediction needs; its size is bounded by terms times languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def scores(self, text: bytes | None) -> np.ndarray | None:
        found = _tf_idf(text, self.idf)
        return None if found is None else found[1] @ self.weights[found[0]] + self.weights[FEATURES]

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """Language and probability; ``und`` and 0 for a text without letters or a model without languages."""
        scores = self.scores(text) if self.languages else None
        if scores is None:
            return UNKNOWN, 0.0
        chances = _softmax(scores / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], round(float(chances[best]), 6)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the documents, which are never learned from: the CRC-32 of the id as text leaves 2 of 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the documents that are not held out and have a text, a language and an id.

    Languages are the distinct values of ``lang_col``. The sample is taken by
    a hash of the id, language by language; repeated rows are sampled together.
    Texts without a letter give a language its name but nothing to learn, and a
    shard without documents counts as one whose weights are zero. No such
    document gives a model that answers ``und``.
    """
    text_batches(docs.sparkSession)
    known = docs.select(
        F.xxhash64(F.lit("language"), F.col(f"`{id_col}`")).alias("deal"), text_bytes(text_col).alias("text"), F.col(f"`{lang_col}`").alias("lang"),
        held_out(id_col).alias("held"), F.col(f"`{id_col}`").isNull().alias("unnamed"),
    ).where("NOT held AND NOT unnamed AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)))

    counts = known.select("text").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = np.zeros(FEATURES + 1)
    for row in counts.collect():
        frequency[row["term"]] = row["n"]
    idf = np.log((1 + frequency[FEATURES]) / (1 + frequency[:FEATURES])) + 1

    per_class = TRAIN_PER_CLASS + CALIBRATE_PER_CLASS
    label = F.create_map(*[x for k, lang in enumerate(languages) for x in (F.lit(lang), F.lit(k))])[F.col("lang")]
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_class / sizes[lang])))])
    place = F.pmod("deal", F.lit(1 << 30)) / (1 << 30) / share[F.col("lang")]
    sample = written(
        known.select(label.alias("label"), "text", "deal", place.alias("place")).where("place < 1")
        .mapInArrow(_rows(idf), "label int, deal long, place double, terms array<int>, values array<double>")
    )
    fit_on = sample.where(F.col("place") < TRAIN_PER_CLASS / per_class)
    shards = fit_on.groupBy(F.pmod("deal", F.lit(SHARDS)).alias("shard")).applyInArrow(_fit(len(languages)), "term int, label int, weight double")
    weights = np.zeros((FEATURES + 1, len(languages)))
    for row in shards.groupBy("term", "label").agg(F.sum("weight").alias("weight")).collect():
        weights[row["term"], row["label"]] = row["weight"] / SHARDS
    model = Model(languages, idf, weights)
    losses = (
        sample.where(F.col("place") >= TRAIN_PER_CLASS / per_class)
        .mapInArrow(_losses(weights), "temperature double, loss double")
        .groupBy("temperature").agg(F.sum("loss").alias("loss"))
    )
    best = losses.orderBy(F.round("loss", 6), "temperature").first()
    if best is not None:
        model.temperature = best["temperature"]
    return model


def _rows(idf: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in range(0, len(batch), 256):
                part = batch.slice(piece, 256)
                found = [_tf_idf(text.as_py(), idf) for text in part.column("text")]
                kept = pa.array([f is not None for f in found])
                found = [f for f in found if f is not None]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c).filter(kept) for c in ("label", "deal", "place")),
                        pa.array([f[0] for f in found], pa.list_(pa.int32())),
                        pa.array([f[1] for f in found], pa.list_(pa.float64())),
                    ],
                    ["label", "deal", "place", "terms", "values"],
                )

    return rows


def _arrays(table: pa.Table | pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(t.values.to_numpy(), v.values.to_numpy()) for t, v in zip(table.column("terms"), table.column("values"))]


def _fit(classes: int):
    def fit(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("deal", "ascending"), ("label", "ascending")])
        weights = fit_shard(shard.column("label").to_numpy(), _arrays(shard), classes)
        term, label = weights.nonzero()
        return pa.table({"term": pa.array(term, pa.int32()), "label": pa.array(label, pa.int32()), "weight": weights[term, label]})

    return fit


def _losses(weights: np.ndarray):
    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for label, (terms, values) in zip(batch.column("label").to_pylist(), _arrays(batch)):
                scores = values @ weights[terms] + weights[FEATURES]
                total -= [np.log(max(_softmax(scores / t)[label], 1e-12)) for t in TEMPERATURES]
        yield pa.RecordBatch.from_arrays([pa.array(TEMPERATURES), pa.array(total)], ["temperature", "loss"])

    return losses


_PREDICTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predicted(model: Model, text_col: str = "text") -> Column:
    """``struct<lang, score>`` of the whole text.

    Null and empty texts and those without a letter give ``und`` and 0; of
    languages that score alike the first by name wins. Repeated rows get the
    same answer, an empty table gives no rows. The model, terms times
    languages, reaches the workers as one of Spark's broadcasts.
    """

    @F.arrow_udf(_PREDICTED)
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(text.as_py()) for text in texts]
        langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
        return pa.StructArray.from_arrays([langs, scores], ["lang", "score"])

    # Else Spark predicts again for every use of the answer.
    return predict.asNondeterministic()(text_bytes(text_col))


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE
) -> DataFrame:
    """The documents whose language the model tells with ``min_score`` or more; ``lang_col`` becomes its answer.

    Null texts and texts without a letter go. Other columns stay as they are,
    and repeated rows get the same answer.
    """
    model = train(docs, id_col, text_col, lang_col)
    told = unused(docs, "told")
    judged = docs.withColumn(told, predicted(model, text_col))
    columns = [F.col(f"{told}.lang").alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns]
    return judged.where((F.col(f"{told}.lang") != UNKNOWN) & (F.col(f"{told}.score") >= min_score)).select(*columns)
