"""Whitening against eigenvectors of the dense covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, whitened string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def expected(rows, k=4):
    """By exact integers and a dense eigenproblem."""
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    away = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return xs, n, sums, values, vectors, np.trace(away.T @ away / n)


def check(got, rows, k=4):
    xs, n, sums, values, vectors, trace = expected(rows, k)
    assert len(got) == k * len(rows)
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    white = np.array([[by_row[i][c]["whitened"] for c in range(1, k + 1)] for i, _ in xs])
    plain = np.array([[c - s / n for c, s in zip(x, sums, strict=True)] for _, x in xs]) @ vectors / np.sqrt(values)
    signs = np.sign((white * plain).sum(0))
    np.testing.assert_allclose(white * signs, plain, rtol=1e-8, atol=1e-9)
    for i, x in xs:
        for c in range(1, k + 1):
            r = by_row[i][c]
            assert r["n"] == n and r["deviation"] == sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
            assert r["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def test_whitening_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    spread = rng.standard_normal((12, 12)) * np.linspace(1, 0.05, 12)
    vectors = (rng.standard_normal((300, 12)) @ spread + 2).astype(np.float32).tolist()
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[7]) for i in range(40)]  # copies count once in the fit
    odd = [(None, None), (5000, None), (5001, []), (5002, [float("nan"), *vectors[0][1:]]), (5003, [float("inf"), *vectors[0][1:]])]
    odd += [(5004, [None, *vectors[0][1:]]), (5005, vectors[0][:5])]
    out = whitening.whiten(table(spark, rows + odd))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), rows)


def test_repeated_values_and_lost_rank(spark):
    """Equal eigenvalues, a constant and a repeated dimension: all directions are found, empty ones left out."""
    rows = []
    for axis, size in enumerate((3, 3, 3, 1)):
        for sign in (-1, 1):
            v = [0.0] * 6
            v[axis] = float(sign * size)
            v[5] = v[3]
            rows.append((len(rows), v))
    got = whitening.whiten(table(spark, rows)).collect()
    _, n, _, values, _, trace = expected(rows)
    assert sorted({(r["component"], round(r["explained"], 9)) for r in got}) == [
        (c + 1, round(values[c] / trace, 9)) for c in range(4)
    ]
    assert all(r["identity_error"] < 1e-9 for r in got) and len(got) == 4 * len(rows)
    flat = whitening.whiten(table(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(5)])).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 5 and flat[0]["explained"] == pytest.approx(1)


def test_empty_small_and_huge(spark):
    assert whitening.whiten(table(spark, [(0, [1.0])]).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(0, None)])).count() == 0
    got = whitening.whiten(table(spark, [(0, [1e30, 0.0]), (1, [-1e30, 0.0]), (2, [0.0, 1.0])])).collect()
    assert len(got) >= 3 and all(r["deviation"] is None for r in got if r["vec_id"] < 2)
    assert all(math.isfinite(r["whitened"]) for r in got)


def test_deviation_stays_exact_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(2**20), 2**20, 3) * 64).astype(float).tolist()) for i in range(50)]
    xs, n, sums, *_ = expected(rows, 3)
    want = {i: sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)) for i, x in xs}
    got = whitening.whiten(table(spark, rows)).filter("component = 1").collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: v if v < 2**63 else None for i, v in want.items()}


def test_bidiagonal_form():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 9)) @ np.diag([1, 1, 1, 1e-3, 2, 2, 0, 0, 5])
    blocks = [x[:13], x[13:]]
    right, band = whitening.bidiagonalise(lambda f, width: sum(f(b) for b in blocks), 9)
    np.testing.assert_allclose(right.T @ right, np.eye(9), atol=1e-13)
    assert not np.tril(band, -1).any() and not np.triu(band, 2).any()
    np.testing.assert_allclose(np.linalg.svd(band)[1], np.linalg.svd(x)[1], atol=1e-11)
    np.testing.assert_allclose(band.T @ band, right.T @ x.T @ x @ right, atol=1e-10)


def test_query(spark, written):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(60)]
    df = table(spark, rows).select("vec_id", "embedding", F.lit(0).alias("label"))
    check(whitening.op11_whitening(spark, written(embeddings=df)).collect(), rows)
