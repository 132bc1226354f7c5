"""Whitening against numpy on whole-number arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from postsignal.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n long, whitened string, v int, i int"


def brute_covariance(x):
    n = len(x)
    sums = [sum(int(v) for v in column) for column in x.T]
    off = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    d = x.shape[1]
    return {(i, j): Fraction(sum(r[i] * r[j] for r in off), n**3) for i in range(d) for j in range(i, d)}, [sum(v * v for v in r) for r in off]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900, [0.0] * 6), (901, rows[0][1]), (901, rows[0][1]), (None, rows[1][1])]
    bad = [(902, None), (903, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (904, [float("nan")] * 6), (905, [float("inf")] + [0.0] * 5), (906, [1.0]), (907, [])]
    table = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows + bad], SCHEMA).repartition(5)
    return table.cache(), rows


def test_against_exact_sums(vectors):
    table, rows = vectors
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(np.float64) * 64).astype(np.int64) + 1_000_000
    want, deviations = brute_covariance(x)
    n, sums, got = W.covariances(W.vectors_of(table))
    assert n == len(rows) and sums == [int(s) for s in x.sum(axis=0)]
    assert {k: Fraction(v, n * n) for k, v in got.items()} == want
    out = W.whitened(table, components=4).toPandas()
    assert len(out) == 4 * len(rows) and set(out.component) == {1, 2, 3, 4}
    assert sorted(out[out.component == 1].deviation) == sorted(deviations)
    cov = np.array([[float(want[min(i, j), max(i, j)]) for j in range(6)] for i in range(6)])
    values, basis = np.linalg.eigh(cov)
    projected = ((x - x.mean(axis=0)) @ basis[:, ::-1][:, :4]) / np.sqrt(values[::-1][:4])
    for c in range(4):
        mine = out[(out.component == c + 1) & out.vec_id.between(0, 299)].sort_values("vec_id").whitened.to_numpy()
        other = projected[:300, c]
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-9
        assert np.allclose(out[out.component == c + 1].explained, values[::-1][c] / values.sum(), rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    assert out.vec_id.isna().sum() == 4 and (out.vec_id == 901).sum() == 8


def test_components_without_variance(spark):
    rows = [(i, [float(i), 1.0, 2.0 * i]) for i in range(20)]
    out = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert len(out) == 60 and out[out.component == 1].whitened.notna().all() and out[out.component > 1].whitened.isna().all()
    assert out.identity_error.max() < 1e-9
    one = W.whitened(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).toPandas()
    assert len(one) == 3 and one.whitened.isna().all() and (one.deviation == 0).all()


def test_large_values_stay_exact(spark):
    rows = [(i, [(-1.0) ** i * 1e9, 3e9 * i]) for i in range(5)]
    x = np.floor(np.array([v for _, v in rows]) * 64).astype(np.int64) + 1_000_000
    n, _, got = W.covariances(W.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {k: Fraction(v, n * n) for k, v in got.items()} == brute_covariance(x)[0]


def test_empty_table(spark, vectors):
    assert W.whitened(vectors[0].filter("false")).count() == 0
    assert W.whitened(vectors[0].filter("vec_id = 902")).count() == 0
    assert W.whitened(vectors[0].filter("vec_id = 907")).count() == 0
