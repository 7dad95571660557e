"""Embedding whitening: leading principal axes by LOBPCG over distributed block products.

The covariance matrix is never formed. A pass over the fit rows multiplies a block of directions by it: a task
centres its rows, forms ``C' (C B)`` for a batch at a time and gives one small block; these are added in groups, then on the driver, where all that
arrives has the size of the dimension times the block. Rayleigh-Ritz on iterate, residual and previous directions gives the next iterate;
the iteration ends when the residuals, taken from a fresh product, are certified to be small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Groups in which the blocks of tasks are added before they come to the driver.
GROUPS = 32
#: Directions that are iterated for each one asked for, so that near eigenvalues don't slow the wanted ones down.
GUARD = 4
#: A residual is small if its length is below this share of the largest eigenvalue. Where rounding keeps it above, the best certified iterate counts
#: if it is below ``ACCEPTED`` and hasn't come down for ``PATIENCE`` iterations.
TOLERANCE, ACCEPTED, PATIENCE = 1e-13, 1e-11, 4
MOST_ITERATIONS = 500
#: Axes whose eigenvalue is below this share of the trace are taken for null: nothing can be divided by them.
NULL_SHARE = 1e-13


@dataclass(frozen=True)
class Axes:
    """A fit: rows, sums, trace of the covariance, eigenvalues and unit vectors (columns), certified residuals, passes over the data."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def quantised(embedding: Column, scale: int = 256) -> Column:
    """Components as whole numbers, ``floor(scale * c)``; null if the vector is null, or holds null or non-finite components."""
    fine = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and len(flat) % n or any(len(column[i]) * n != len(flat) for i in (0, n - 1) if n):
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1)


def _added(rows: DataFrame, block: Callable[[np.ndarray], np.ndarray], dtype: str) -> np.ndarray | None:
    """The sum of ``block`` over batches of ``rows(x)``: added within a task, within groups of tasks, and at last on the driver. None without rows."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = block(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"shape": [",".join(map(str, total.shape))], "part": [np.ascontiguousarray(total, dtype).tobytes()]})

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shape = None, ""
        for batch in batches:
            for s, p in zip(batch.column("shape").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if total is not None and s != shape:
                    raise ValueError("vectors of different lengths")
                total = np.frombuffer(p, dtype) + (0 if total is None else total)
                shape = s
        if total is not None:
            yield pa.RecordBatch.from_pydict({"shape": [shape], "part": [total.tobytes()]})

    parts = rows.select("x").mapInArrow(of_task, "shape string, part binary")
    if parts.rdd.getNumPartitions() > GROUPS:
        parts = parts.repartition(GROUPS, F.spark_partition_id()).mapInArrow(of_group, "shape string, part binary")
    parts = parts.collect()
    if len({r["shape"] for r in parts}) > 1:
        raise ValueError("vectors of different lengths")
    if not parts:
        return None
    total = sum(np.frombuffer(r["part"], dtype) for r in sorted(parts, key=lambda r: bytes(r["part"])))
    return total.reshape([int(s) for s in parts[0]["shape"].split(",")])


def _orthonormal(block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, without those that the others span."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > 0] / lengths[lengths > 0]
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return u[:, s > s[0] * 1e-10]


def lobpcg(product: Callable[[np.ndarray], np.ndarray], start: np.ndarray, wanted: int, tolerance: float = TOLERANCE, most: int = MOST_ITERATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residual lengths, products) of the ``wanted`` largest eigenpairs of a symmetric matrix known by its block product.

    ``start`` is the first block, with guard columns. A product is taken for the new residual directions only; those of iterate and previous directions
    are carried as combinations. Convergence counts only when a fresh product of the iterate confirms it. Raises ``ArithmeticError`` if that fails.
    """
    width = start.shape[1]
    x = _orthonormal(start)
    ax, products, fresh = product(x), 1, True
    p = np.zeros((len(x), 0))
    ap, best, since = p, None, 0
    for _ in range(most):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        order = np.argsort(-values)
        values, x, ax = values[order], x @ turn[:, order], ax @ turn[:, order]
        residual = ax - x * values
        lengths = np.linalg.norm(residual, axis=0)
        share = lengths[:wanted].max() / max(abs(values[0]), np.finfo(float).tiny)
        if fresh:
            since += 1
            if best is None or share < best[0]:
                best, since = (share, values[:wanted], x[:, :wanted], lengths[:wanted]), 0
            if share <= tolerance or best[0] <= ACCEPTED and since >= PATIENCE:
                return *best[1:], products
        held = np.hstack([x, p])
        w = residual
        for _again in range(3):  # what is left of a nearly spent direction has to be cleaned after it is scaled up
            w = _orthonormal(w - held @ (held.T @ w))
        if (share <= tolerance or not w.shape[1]) and not fresh:
            ax, products, fresh = product(x), products + 1, True
            continue
        if not w.shape[1]:
            break
        aw, products = product(w), products + 1
        # the three blocks are orthonormal, and all that is carried comes of orthonormal combinations, so errors don't grow
        s, images = np.hstack([x, w, p]), np.hstack([ax, aw, ap])
        small_matrix = s.T @ images
        v, turn = np.linalg.eigh((small_matrix + small_matrix.T) / 2)
        c = turn[:, np.argsort(-v)[:width]]
        k = x.shape[1]
        rest = np.vstack([np.zeros_like(c[:k]), c[k:]])
        rest = rest - c @ (c.T @ rest)
        rest = _orthonormal(rest)
        rest = rest - c @ (c.T @ rest)
        rest = _orthonormal(rest)[:, : s.shape[1] - width]
        x, ax, p, ap = s @ c, images @ c, s @ rest, images @ rest
        fresh = share <= ACCEPTED
        if fresh:  # near the end, what was carried is taken anew
            x = np.linalg.qr(x)[0]
            p = np.zeros((len(x), 0))
            ap, ax, products = p, product(x), products + 1
    if best is not None and best[0] <= ACCEPTED:
        return *best[1:], products
    raise ArithmeticError("the residuals didn't become small")


def fit(rows: DataFrame, components: int = 4) -> Axes | None:
    """The leading axes of the covariance of ``rows(x)``, whole numbers, divisor n. None without rows or dimensions.

    Axes of no variance are left out, so equal rows have none. Vectors of different lengths raise ``ValueError``.
    """

    def summed(x: np.ndarray) -> np.ndarray:
        x = x.astype(object) if len(x) and int(np.abs(x).max(initial=0)) > 2**62 // len(x) else x
        return np.array([[len(x), *x.sum(axis=0)]], dtype=object).astype("<i8")

    totals = _added(rows, summed, "<i8")
    if totals is None or totals.shape[1] < 2:
        return None
    n, sums = int(totals[0, 0]), [int(s) for s in totals[0, 1:]]
    mean = np.array([s / n for s in sums])
    d = len(sums)

    def product(block: np.ndarray) -> np.ndarray:
        return _added(rows, lambda x: (c := x - mean).T @ (c @ block), "<f8") / n

    trace = float(_added(rows, lambda x: np.array([((x - mean) ** 2).sum()]), "<f8")[0]) / n
    if not trace:
        return Axes(n, tuple(sums), 0.0, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 2)
    wanted = min(components, d)
    start = np.random.default_rng(12).standard_normal((d, min(d, GUARD * wanted)))
    values, vectors, residuals, passes = lobpcg(product, start, wanted)
    kept = values > NULL_SHARE * trace
    values, vectors, residuals = values[kept], vectors[:, kept], residuals[kept]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    return Axes(n, tuple(sums), trace, values, vectors, residuals, passes + 2)


def projector(axes: Axes) -> Callable[[np.ndarray], np.ndarray]:
    """Whitening of rows: centred, projected on the axes, divided by the root of the eigenvalue."""
    mean, turn = np.array([s / axes.n for s in axes.sums]), axes.vectors / np.sqrt(axes.values)
    return lambda x: (x - mean) @ turn


def identity_error(rows: DataFrame, axes: Axes) -> float:
    """The largest absolute entry of the covariance of the whitened ``rows(x)`` minus the identity, from a pass over the rows."""
    white = projector(axes)

    def moments(x: np.ndarray) -> np.ndarray:
        y = white(x)
        return np.vstack([y.T @ y, y.sum(axis=0)])

    m = _added(rows, moments, "<f8") / axes.n
    k = len(axes.values)
    return float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max()) if k else 0.0


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The exact sum of ``(n * x - S) ** 2`` of each row; ``OverflowError`` where it is no long."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    if max(exact) >= 2**63:
        raise OverflowError("a deviation is no long")
    return exact


def whiten(embeddings: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row of ``embeddings(vec_id, embedding)`` and component.

    Rows whose vector is null or holds null or non-finite entries are left out, so are components without variance: equal vectors,
    or a table without vectors, give no row. Repeated vectors count once in the fit; rows with a null or repeated id each have their own result. Vectors of different
    lengths raise ``ValueError``. Other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("x")).where("x IS NOT NULL")
    listed = written(rows.select("x").distinct())
    axes = fit(listed, components)
    if axes is None or not len(axes.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    error, white, share, k = identity_error(listed, axes), projector(axes), axes.values / axes.trace, len(axes.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, m = _matrix(batch.column(1)), batch.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, axes.n)),
                "deviation": pa.array(deviations(x, axes.n, axes.sums), pa.int64()).take(each), "whitened": pa.array(white(x).ravel()), "explained": pa.array(np.tile(share, m)), "identity_error": pa.array(np.full(m * k, error)),
            })

    return rows.mapInArrow(run, schema)
