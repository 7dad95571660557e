"""Whitening against a full eigendecomposition, its exact columns, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=4):
    """(rows kept, distinct x, deviations, whitened up to sign, shares) with numpy's eigh."""
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    u = np.unique(x, axis=0)
    e, v = np.linalg.eigh(np.cov(u.T, bias=True).reshape(u.shape[1], -1))
    e, v = e[::-1], v[:, ::-1]
    s = u.sum(axis=0)
    return [i for i, _ in kept], u, [int(sum((len(u) * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True))) for r in x], (x - u.mean(axis=0)) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("n, d, partitions", [(300, 24, 3), (500, 12, 70), (40, 3, 2)])
def test_against_a_full_decomposition(spark, n, d, partitions):
    r = np.random.default_rng(n)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.standard_normal((n, d)) * np.linspace(1, 2, d))]
    rows += [(n + i, rows[i][1]) for i in range(n // 4)] + [(7, rows[3][1]), (None, rows[5][1])]
    bad = [(10**6, None), (10**6 + 1, [None] * d), (10**6 + 2, [float("nan")] * d), (10**6 + 3, [float("inf")] + [0.0] * (d - 1))]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(partitions).withColumns({"x": F.lit(1), "n": F.lit("n"), "component": F.lit(None).cast("int")})
    ids, u, deviations, white, share = brute(rows)
    k = min(4, d)
    got = W.whiten(df).collect()
    assert len(got) == len(ids) * k and {g.n for g in got} == {len(u)}
    assert sorted((g.vec_id is None, g.vec_id or 0, g.deviation) for g in got if g.component == 1) == sorted((i is None, i or 0, v) for i, v in zip(ids, deviations, strict=True))
    by_row = {}
    for g in got:
        by_row.setdefault((g.vec_id, g.deviation), {})[g.component] = g
    sign = [1.0] * k
    for j in range(k):
        at = int(np.abs(white[:, j]).argmax())
        sign[j] = np.sign(by_row[ids[at], deviations[at]][j + 1].whitened) * np.sign(white[at, j])
    for i, (own, v) in enumerate(zip(ids, deviations, strict=True)):
        for j in range(k):
            g = by_row[own, v][j + 1]
            assert abs(g.whitened - sign[j] * white[i, j]) < 1e-9 and abs(g.explained / share[j] - 1) < 1e-9
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("name", ["flat", "steep", "same", "wide", "two"])
def test_residuals_are_certified(name):
    r = np.random.default_rng(4)
    q = np.linalg.qr(r.standard_normal((60, 60)))[0]
    v = {"flat": np.cov(r.standard_normal((60, 2000))), "steep": (q * 10.0 ** -np.arange(60)) @ q.T, "same": np.eye(60), "wide": np.cov(r.standard_normal((300, 900))), "two": (b := r.standard_normal((60, 2))) @ b.T}[name]
    products = []
    values, vectors, residuals, n = W.lobpcg(lambda b: products.append(b.shape[1]) or v @ b, np.random.default_rng(12).standard_normal((len(v), 16)), 4)
    assert n == len(products) and n < 150
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:4]).max() < 1e-9 * values[0]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 2 * W.ACCEPTED * values[0] and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert residuals.max() <= W.ACCEPTED * values[0]


def test_tables_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [])]):
        assert W.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]  # one direction only
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {g.component for g in got} == {1} and len(got) == 5 and abs(got[0].explained - 1) < 1e-12
    with pytest.raises(Exception, match="different lengths"):
        W.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA).coalesce(1)).collect()


def test_deviations_are_exact_or_refused():
    x = np.array([[3 * 10**6, -5], [7, 2**20]])
    assert W.deviations(x, 10**3, (11, -13)) == [sum((10**3 * int(c) - s) ** 2 for c, s in zip(row, (11, -13), strict=True)) for row in x]
    with pytest.raises(OverflowError):
        W.deviations(np.array([[2**40]]), 2**20, (0,))
