"""Whitening of embeddings by shifted CholeskyQR.

The vectors become fixed-point integers, so their number, sums and centred
values are exact. The rows, centred, are a tall matrix A. Each pass over them
forms the Gram matrix of A R^-1 (R so far the identity), whose Cholesky factor
multiplies R from the left; after a few passes A R^-1 has orthonormal columns
and A = Q R. The singular values and right vectors of the small R are those of
A: the whitening components, without ever squaring the condition of A. A shift
of the diagonal keeps the first, ill-conditioned factor definite.

Rows stay where they are: a task hands on sums and Gram cells of its
partition, and only R, square in the number of dimensions, is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet import workers
from freshet.llm.common import unused

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: One shifted pass makes the rows well conditioned; two more make them orthonormal to double precision.
PASSES = 3
#: Fixed-point values below this are exact as doubles, their sums of some thousand rows as integers.
_BOUND = 2.0**48
_UNIT = np.finfo(np.float64).eps
_BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """A fitted transform. ``axes`` has one component per row, by falling ``eigenvalues``."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    eigenvalues: np.ndarray
    total: float
    scale: int = SCALE
    offset: int = OFFSET

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: 64-bit integers where they suffice, else Python's."""
        if self.n * (float(np.abs(x).max(initial=0)) + 1) * 2 < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, each over its deviation; NaN on a component without any."""
        with np.errstate(divide="ignore", invalid="ignore"):
            on_axes = self.centred(x) @ self.axes.T / np.sqrt(self.eigenvalues)
        on_axes[:, self.eigenvalues <= 0] = np.nan
        return on_axes


def fixed_point(vectors: pa.Array, scale: int, offset: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, integers)`` for each length of vector: what can be used, and ``floor(scale * c) + offset`` of its entries.

    Null and empty vectors, and those with an entry that is null, not finite
    or too large for exact arithmetic (2^48 after scaling), are left out.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy()
    lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    entries = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        scaled = np.floor(entries[offsets[rows][:, None] + np.arange(length)] * scale)
        usable = (np.abs(scaled) < _BOUND).all(axis=1)  # false for NaN and infinity
        yield rows[usable], scaled[usable].astype(np.int64) + offset


def solve_lower_right(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows @ inv(upper)`` by substitution, column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def factor(gram: np.ndarray, n: int) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix of ``n`` rows, shifted.

    The shift is above the rounding of the sums, which grows with the square
    root of the rows; later passes undo it. Columns without any length get 1.
    """
    d = len(gram)
    shift = 11 * _UNIT * (d * (d + 1) + d * np.sqrt(n)) * np.trace(gram) / d
    while True:
        try:
            return np.linalg.cholesky(gram + (shift or 1.0) * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 16


def _sum_pass(df: DataFrame, vector_col: str, scale: int, offset: int) -> tuple[int, list[int]]:
    """The number of vectors of the most frequent length and their sums; nothing gives ``(0, [])``."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, x in fixed_point(batch.column(0), scale, offset):
                d = x.shape[1]
                counts[d] = counts.get(d, 0) + len(rows)
                whole = x if len(x) < 2**14 else x.astype(object)  # 2^48 times 2^14 fits into 64 bits
                sums[d] = sums.get(d, 0) + whole.sum(axis=0).astype(object)
        for d, n in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                 pa.array([str(s) for s in sums[d]])], ["d", "pos", "n", "s"])

    parts = df.select(F.col(f"`{vector_col}`")).mapInArrow(partition, "d int, pos int, n long, s string")
    cells = parts.groupBy("d", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    cells = cells.where("n > 0")
    best = cells.where("pos = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return 0, []
    return best.n, [int(r.s) for r in cells.where(F.col("d") == best.d).orderBy("pos").collect()]


def _gram(df: DataFrame, vector_col: str, model: Whitening, rows_of, width: int) -> np.ndarray:
    """The sum of ``y^T y`` over the rows ``y = rows_of(x)`` of all usable vectors."""
    upper, d = np.triu_indices(width), len(model.sums)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in fixed_point(batch.column(0), model.scale, model.offset):
                for k in range(0, len(x) if x.shape[1] == d else 0, _BLOCK):
                    y = rows_of(x[k : k + _BLOCK])
                    total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], ["cell", "v"]
        )

    cells = df.select(F.col(f"`{vector_col}`")).mapInArrow(partition, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    gram = np.zeros((width, width))
    for cell, v in cells.collect():
        gram[upper[0][cell], upper[1][cell]] = gram[upper[1][cell], upper[0][cell]] = v
    return gram


def fit(
    df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET
) -> Whitening:
    """Fit on all usable vectors (see :func:`fixed_point`) of the most frequent length, the longer one of a tie.

    Repeated vectors count as often as they come. Components beyond the rank
    of the vectors have eigenvalue zero. No usable vector gives no component.
    """
    workers.ship(df.sparkSession)
    n, sums = _sum_pass(df, vector_col, scale, offset)
    d = len(sums)
    model = Whitening(n, tuple(sums), np.zeros((0, d)), np.zeros(0), 0.0, scale, offset)
    if not n:
        return model
    factors: list[np.ndarray] = []
    for _ in range(PASSES):
        done = tuple(factors)

        def orthogonal(x: np.ndarray) -> np.ndarray:
            y = model.centred(x)
            for r in done:
                y = solve_lower_right(y, r)
            return y

        factors.append(factor(_gram(df, vector_col, model, orthogonal, d), n))
    composed = np.eye(d)
    for r in factors:
        composed = r @ composed
    _, singular, axes = np.linalg.svd(composed)
    known = (singular > d * 16 * _UNIT * singular[0]) & any(factors[0].ravel() != np.eye(d).ravel())
    eigenvalues = np.where(known, singular**2 / n, 0.0)
    k = min(components, d)
    return Whitening(n, tuple(sums), axes[:k], eigenvalues[:k], float(eigenvalues.sum()), scale, offset)


def identity_error(df: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """How far the covariance of the whitened fit list is from the identity, at its worst entry; 0 without components."""
    known = int((model.eigenvalues > 0).sum())
    if not known:
        return 0.0
    gram = _gram(df, vector_col, model, lambda x: model.whiten(x)[:, :known], known) / model.n
    return float(np.abs(gram - np.eye(known)).max())


def whitened(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, deviation, whitened, explained)``: one row per usable vector and component, from 1.

    Ids are passed on as they are, null and repeated ones too. ``deviation``
    is the exact sum of ``(n * x - S)^2``, null beyond 64 bits. A component
    without variance (vectors all alike, or fewer than dimensions) has
    ``explained`` 0 and ``whitened`` null. Rows that cannot be used, or whose
    length is not the fitted one, are left out; an empty table gives no rows.
    """
    workers.ship(df.sparkSession)
    k, d = len(model.axes), len(model.sums)
    explained = model.eigenvalues / model.total if model.total > 0 else np.zeros(k)
    name = unused(df, "id")
    schema = T.StructType([
        T.StructField(name, df.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
    ])

    def square(deviations: np.ndarray) -> pa.Array:
        if deviations.dtype != object and float(np.abs(deviations).max(initial=0)) ** 2 * d < 2**62:
            return pa.array(np.einsum("ij,ij->i", deviations, deviations))
        exact = [sum(int(z) ** 2 for z in row) for row in deviations]
        return pa.array([s if s < 2**63 else None for s in exact], pa.int64())

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in fixed_point(batch.column(1), model.scale, model.offset):
                if x.shape[1] != d:
                    continue
                each = np.repeat(np.arange(len(rows)), k)
                values = model.whiten(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[each])),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                     square(model.deviations(x)).take(pa.array(each)),
                     pa.array(values, mask=np.isnan(values)),
                     pa.array(np.tile(explained, len(rows)))], schema.names)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")).mapInArrow(partition, schema).withColumnRenamed(name, "id")
