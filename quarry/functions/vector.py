"""Vector functions as Column expressions, accumulating in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    """max(0, 1 - cosine); vectors of length 0 are to be rejected before."""
    return F.greatest(F.lit(0.0), 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return cosine_distance(a, b) if metric == "cosine" else squared_l2(a, b)


def relative_squared_error(actual: Column, expected: Column) -> Column:
    return squared_l2(actual, expected) / F.greatest(dot(expected, expected), F.lit(1e-20))


def valid(v: Column, dimension: int, metric: str = "cosine") -> Column:
    """Of the right length and finite, and for cosine not all zero."""
    ok = v.isNotNull() & (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0) if metric == "cosine" else ok, F.lit(False))
