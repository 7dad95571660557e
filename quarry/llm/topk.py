"""Exact top-k search by inner product over vectors sorted by length.

Vectors are kept in blocks by descending length, and a block is met by a block of queries at a time. Three
bounds, each by Cauchy-Schwarz, spare work, none of them loses a result or a tie:

* lengths: a query block meets the blocks up to the first whose longest vector can't reach any of its queries' k-th score
  so far, which a first pass over the longest vectors gives;
* in a block, the vectors up to the first that is too short for every query there;
* partial sums: vectors are turned into the basis of their own singular vectors, where the first coordinates hold most of
  the length; a pair whose product over those, plus the product of the lengths of what is left, stays below is dropped.

What remains is computed in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ints, shuffle_partitions, written

#: Vectors and queries in a block.
BLOCK, QUERY_BLOCK = 2048, 512
#: The share of the squared lengths that the first coordinates are to hold.
HEAD_SHARE = 0.8


def quantised(vector: Column, scale: float = 64.0) -> Column:
    """``floor(scale * x)`` of each component as a double; null for a null vector or one with null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _dense(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column as a matrix; shorter lists are filled up with 0."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(ends)
    if len(size) and (size == dimension).all():
        return values[ends[0] : ends[-1]].reshape(len(size), dimension)
    out = np.zeros((len(size), dimension), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], size)] = values[ends[0] : ends[-1]]
    return out


def _blocks(vectors: DataFrame, size: int, dimension: int, dtype: str) -> DataFrame:
    """(top, n, ids, data): blocks by descending length, ties by id; ``top`` is the largest squared length in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = np.zeros(0, np.int64), np.zeros((0, dimension), np.int64)

        def block(n: int) -> pa.RecordBatch:
            top = int((rows[0] ** 2).sum())
            return pa.record_batch([pa.array([top]), pa.array([n]), pa.array([ids[:n].astype("<i8").tobytes()]), pa.array([rows[:n].astype(dtype).tobytes()])], ["top", "n", "ids", "data"])

        for batch in batches:
            ids, rows = np.concatenate((ids, ints(batch.column(0)))), np.concatenate((rows, _dense(batch.column(1), dimension)))
            while len(ids) >= size:
                yield block(size)
                ids, rows = ids[size:], rows[size:]
        if len(ids):
            yield block(len(ids))

    parts = shuffle_partitions(vectors.sparkSession)
    order = [F.desc("length2"), F.col("vec_id")]
    return vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "v").mapInArrow(run, "top long, n long, ids binary, data binary")


def _basis(vectors: DataFrame, dimension: int) -> tuple[np.ndarray, int]:
    """(V, h): the right singular vectors of all vectors by descending singular value, and how many of them hold ``HEAD_SHARE`` of the squared lengths.

    Tasks return the upper products of their rows, dimension ** 2 numbers each, which are summed before they reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dimension, dimension))
        for batch in batches:
            rows = _dense(batch.column(0), dimension).astype(np.float64)
            gram += rows.T @ rows
        yield pa.record_batch([pa.array(np.arange(dimension * dimension)), pa.array(gram.ravel())], ["i", "x"])

    sums = vectors.select("v").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()
    if not len(sums):
        return np.eye(dimension), dimension
    value, basis = np.linalg.eigh(sums["x"].to_numpy().reshape(dimension, dimension))
    value = np.maximum(value[::-1], 0)
    share = np.cumsum(value) / max(value.sum(), 1e-300)
    return np.ascontiguousarray(basis[:, ::-1]), int(min(dimension, np.searchsorted(share, HEAD_SHARE) + 1))


def search_block(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, rows: np.ndarray, ids: np.ndarray, basis: np.ndarray, head: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score, new least): the pairs among which are each query's ``k`` best of this block that reach ``least``.

    ``queries`` and ``rows`` are integer matrices, ``rows`` by descending length. ``least`` has each query's k-th best score so
    far, or minus infinity.
    """
    q, c = queries.astype(np.float64), rows.astype(np.float64)
    q_length, c_length = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    slack = 1e-9 * max(1.0, q_length.max(initial=0)) * max(1.0, c_length.max(initial=0)) + 1e-6
    need = np.where(np.isneginf(least), -np.inf, least - slack)
    # a vector is long enough if it is for some query; lengths descend
    reach = np.min(np.where(np.isneginf(need), -np.inf, np.where(need > 0, need / np.maximum(q_length, 1e-300), -np.inf)), initial=np.inf)
    n = int(np.searchsorted(-c_length, -reach, "right")) if np.isfinite(reach) else len(c)
    if not n or not len(q):
        z = np.zeros(0, np.int64)
        return z, z, z, least
    c, rows, ids, c_length = c[:n], rows[:n], ids[:n], c_length[:n]
    exact = float(q_length.max()) * float(c_length.max()) < 2**52
    keep = None
    if np.isfinite(need).any() and head < q.shape[1]:
        qr, cr = q @ basis, c @ basis
        rest_q = np.sqrt((qr[:, head:] ** 2).sum(1))
        rest_c = np.sqrt((cr[:, head:] ** 2).sum(1))
        keep = qr[:, :head] @ cr[:, :head].T + np.outer(rest_q, rest_c) >= need[:, None]
    if keep is not None and exact and keep.sum() < keep.size // 16:
        a, b = np.nonzero(keep)
        score = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65536]], c[b[i : i + 65536]]) for i in range(0, max(1, len(a)), 65536)]).astype(np.int64)
        ok = (query_ids[a] != ids[b]) & (score >= least[a])
        return a[ok], b[ok], score[ok], least
    product = (q @ c.T).astype(np.int64) if exact else queries.astype(np.int64) @ rows.astype(np.int64).T
    other = query_ids[:, None] != ids[None, :]
    if n > k:
        # the k-th of those that aren't the query's own; a block holds its own id at most a few times
        shown = np.where(other, product, np.iinfo(np.int64).min)
        kth = np.partition(shown, n - k, axis=1)[:, n - k]
        least = np.maximum(least, np.where(kth == np.iinfo(np.int64).min, -np.inf, kth.astype(np.float64)))
    a, b = np.nonzero(other & (product >= least[:, None]))
    return a, b, product[a, b], least


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: by score descending, then id."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1)) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
    return order[rank < k]


def top_inner_products(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors(vec_id, v array<long>)`` that ``is_query`` marks, the ``k`` rows with the highest inner product, ties to the smaller id.

    A query's own id takes no part in its answer; with fewer than ``k`` others all are returned. Null vectors, vectors with null
    components and null ids take no part; missing components at the end count as 0. Repeated ids are rows of their own. Inner products
    have to fit into 64 bits. Other columns are not read; the table may be empty.
    """
    spark = vectors.sparkSession
    whole = F.expr("aggregate(v, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)")
    sound = vectors.where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").select(F.col("vec_id").cast("long").alias("vec_id"), "v", whole.alias("length2"), is_query.alias("asks"))
    sound = written(sound)
    dimension, most = sound.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.lit(0))).first()
    dimension, dtype = max(1, dimension), "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    basis, head = _basis(sound, dimension)
    turned = spark.sparkContext.broadcast((basis, head))  # dimension ** 2 numbers

    ranked = F.row_number().over(Window.orderBy(F.desc("top"), "first")) - 1  # over one row a block, without its vectors
    blocks = written(_blocks(sound, BLOCK, dimension, dtype).withColumn("block", F.monotonically_increasing_id()))
    places = blocks.select("block", "top", F.col("block").alias("first")).select("block", "top", ranked.alias("place"))
    blocks = written(blocks.drop("top").join(places, "block").drop("block"))
    asked = written(_blocks(sound.where("asks"), QUERY_BLOCK, dimension, dtype).select("n", F.col("ids").alias("query_ids"), F.col("data").alias("queries"), F.monotonically_increasing_id().alias("query_block")))

    def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        own = np.frombuffer(ids, "<i8")
        return own, np.frombuffer(data, dtype).reshape(len(own), dimension)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                query_ids, queries = unpack(r["query_ids"], r["queries"])
                ids, rows = unpack(r["ids"], r["data"])
                least = search_block(queries, query_ids, np.full(len(queries), -np.inf), rows, ids, *turned.value, k)[3]
                length = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
                # shorter vectors than this can't reach any query of the block
                reach = float(np.min(np.where(least > 0, least / np.maximum(length, 1e-300), 0.0))) * (1 - 1e-9)
                yield pa.record_batch([pa.array([r["query_block"]]), pa.array([least.tobytes()]), pa.array([reach * reach])], ["query_block", "least", "reach2"])

    longest = blocks.where("place = 0").select("ids", "data")
    seeds = asked.withColumn("place", F.lit(0)).join(F.broadcast(longest.withColumn("place", F.lit(0))), "place").drop("place", "n").mapInArrow(seed, "query_block long, least binary, reach2 double")
    seeds = written(seeds)
    span = _spans(seeds, places)
    pairs = span.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("upto") - 1))).drop("upto")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                query_ids, queries = unpack(r["query_ids"], r["queries"])
                ids, rows = unpack(r["ids"], r["data"])
                a, b, score, _ = search_block(queries, query_ids, np.frombuffer(r["least"], np.float64), rows, ids, *turned.value, k)
                best = _best(a, ids[b], score, k)
                yield pa.record_batch([pa.array(query_ids[a[best]]), pa.array(ids[b[best]]), pa.array(score[best])], ["query_id", "vec_id", "score"])

    met = pairs.join(asked, "query_block").repartition(shuffle_partitions(spark), "place").join(blocks.select("place", "ids", "data"), "place").select("query_ids", "queries", "least", "ids", "data").mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _spans(seeds: DataFrame, places: DataFrame) -> DataFrame:
    """(query_block, least, upto): how many blocks, from the longest on, a query block meets.

    Blocks descend by length, so a block's place tells how many are at least as long: a merge of the two sorted columns.
    """
    marks = seeds.select(F.col("reach2").alias("x"), "query_block", "least", F.lit(-1).alias("place")).unionByName(places.select(F.col("top").cast("double").alias("x"), F.lit(None).cast("long").alias("query_block"), F.lit(None).cast("binary").alias("least"), F.col("place").cast("int")))
    # over a row for each block and each query block
    last = F.max("place").over(Window.orderBy(F.desc("x"), F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marks.withColumn("upto", F.greatest(last + 1, F.lit(1))).where("query_block IS NOT NULL").select("query_block", "least", "upto")
