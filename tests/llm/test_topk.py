import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import topk
from quarry.llm.topk import quantised, top_inner_products


def brute(rows, asks, k):
    out = {}
    for q, v in rows:
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q)
            out[q] = [(n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize(("scale", "n", "block"), [(3, 400, 64), (1000, 300, 2048), (1 << 29, 120, 32)])
def test_equals_brute_force(spark, monkeypatch, scale, n, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    r = random.Random(scale)
    directions = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = []
    for i in range(n):
        length = scale * r.choice([0, 0.05, 0.3, 1]) * r.random()
        d = r.choice(directions)
        rows.append((i, [round(length * (x + r.gauss(0, 0.2))) for x in d]))
    rows += [(n + i, rows[i][1]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in [*rows, (None, [1] * 8), (9000, None), (9001, [1] * 7 + [None])]], "vec_id long, v array<long>, score int")
    got = {}
    for x in top_inner_products(df, F.col("vec_id") % 7 == 0, 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert {q: sorted(v) for q, v in got.items()} == brute(rows, lambda i: i % 7 == 0, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [])], "vec_id long, v array<long>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in top_inner_products(df, F.col("vec_id") == 0, 20).collect())
    assert got == [(0, 1, 1, 3), (0, 2, 2, 0)]
    assert top_inner_products(df.limit(0), F.col("vec_id") == 0, 20).count() == 0
    assert top_inner_products(df, F.lit(False), 20).count() == 0


def test_quantised(spark):
    rows = [([0.5, -0.001, 1.0],), ([float("nan"), 1.0],), ([float("inf")],), (None,), ([None, 1.0],), ([],)]
    got = [x.q for x in spark.createDataFrame(rows, "e array<float>").select(quantised(F.col("e")).alias("q")).collect()]
    assert [None if x is None else list(x) for x in got] == [[32, -1, 64], None, None, None, None, []]


def test_search_block_bounds():
    rng = np.random.default_rng(1)
    rows = np.round(rng.normal(0, 1, (500, 16)) * np.linspace(40, 1, 16)).astype(np.int64)
    rows = rows[np.argsort(-(rows**2).sum(1), kind="stable")]
    queries, ids = rows[::25], np.arange(500)
    basis = np.linalg.svd(rows, full_matrices=False)[2].T
    scores = queries @ rows.T
    least = np.sort(scores, 1)[:, -10].astype(float)
    a, b, s, _ = topk.search_block(queries, -1 - np.arange(20), least, rows, ids, basis, 4, 10)
    assert {(int(x), int(y)) for x, y in zip(a, b, strict=True)} == {(i, j) for i in range(20) for j in range(500) if scores[i, j] >= least[i]}
    assert all(scores[x, y] == z for x, y, z in zip(a, b, s, strict=True)) and math.isfinite(least.sum())


def test_columns_named_as_its_own(spark):
    names = ["length2", "asks", "top", "place", "score", "rank"]
    df = spark.createDataFrame([(i, [i, -i, 1], *[i] * 6) for i in range(30)], "vec_id long, v array<long>, " + ", ".join(f"{x} int" for x in names))
    ask = F.col("asks") % 10 == 0
    told = lambda d: sorted((x.query_id, x.rank, x.vec_id, x.score) for x in top_inner_products(d, ask, 3).collect())
    want = []
    for q in (0, 10, 20):
        best = sorted((-(2 * q * c + 1), c) for c in range(30) if c != q)[:3]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    assert told(df) == want
