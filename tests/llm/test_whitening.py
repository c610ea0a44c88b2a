import math

import numpy as np
import pytest

from freshet.llm import whitening
from freshet.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, id string"


def brute(vectors: list[list[float]]):
    """Exact integers, then an eigendecomposition of the covariance."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return n, deviation, centred, values[order], axes[:, order].T


def check(found, vectors, k=8):
    n, deviation, centred, values, axes = brute(vectors)
    k = min(k, len(values))
    assert len(found) == n * k
    total = values.sum()
    got = np.zeros((n, k))
    for r in found:
        assert r.deviation == deviation[r.id]
        assert r.explained == pytest.approx(values[r.component - 1] / total, rel=1e-9)
        got[r.id, r.component - 1] = r.whitened
    want = centred @ axes[:k].T / np.sqrt(values[:k])
    for j in range(k):
        assert np.allclose(got[:, j], want[:, j], atol=1e-8) or np.allclose(got[:, j], -want[:, j], atol=1e-8)


def test_equal_to_eigendecomposition(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    vectors = [[float(np.float32(c)) for c in v] for v in mixed]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], SCHEMA).repartition(3)
    model = whitening.fit(df)
    check(whitening.whitened(df, model).collect(), vectors)
    assert whitening.identity_error(df, model) < 1e-9


def test_small_variances_beside_large_ones_keep_their_digits(spark):
    rng = np.random.default_rng(6)
    spread = 10.0 ** np.linspace(4, -1, 10)
    turn = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    vectors = (rng.normal(size=(400, 10)) * spread @ turn).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(df, components=10)
    n, _, centred, _, _ = brute(vectors)
    singular = np.linalg.svd(centred, compute_uv=False)
    assert np.allclose(model.eigenvalues, singular**2 / n, rtol=1e-9)
    assert whitening.identity_error(df, model) < 1e-6


def test_rows_that_cannot_be_used(spark):
    good = [[0.5, -0.25, 1.0], [0.1, 0.2, 0.3], [-0.4, 0.7, 0.0], [0.5, -0.25, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 0.0, 0.0], [3e38, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, None) for i, v in enumerate(good)] + [(None, v, "a") for v in bad]
    df = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit(df)
    assert model.n == 4 and len(model.axes) == 3
    found = whitening.whitened(df, model).collect()
    assert {r.id for r in found} == {0, 1, 2, 3} and len(found) == 12
    assert model.eigenvalues[2] == 0  # three different points span a plane
    assert all((r.whitened is None) == (r.component == 3) for r in found)
    assert [r.whitened for r in found if r.id == 0] == [r.whitened for r in found if r.id == 3]
    assert whitening.identity_error(df, model) < 1e-9


def test_all_alike_none_and_null_ids(spark):
    alike = spark.createDataFrame([(None, [1.0, 2.0], "")] * 3, SCHEMA)
    model = whitening.fit(alike)
    found = whitening.whitened(alike, model).collect()
    assert len(found) == 6 and all(r.id is None and r.whitened is None and r.explained == 0 and r.deviation == 0 for r in found)
    assert whitening.identity_error(alike, model) == 0
    for rows in ([], [(1, None, None)]):
        empty = spark.createDataFrame(rows, SCHEMA)
        model = whitening.fit(empty)
        assert model.n == 0 and whitening.whitened(empty, model).count() == 0


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e9, 0.0]), (1, [-1e9, 0.5]), (2, [0.0, 0.25])], "vec_id long, embedding array<double>")
    found = {(r.id, r.component): r for r in whitening.whitened(df, whitening.fit(df)).collect()}
    assert found[0, 1].deviation is None and found[2, 1].deviation == (3 * (256 + 100_000) - 300_768) ** 2


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    found = QUERIES["op13_whitening"](spark, sf).withColumnRenamed("vec_id", "id").collect()
    check(found, vectors)
    assert {r.n for r in found} == {len(vectors)} and max(r.identity_error for r in found) < 1e-9
