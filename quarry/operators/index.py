"""An index of cells over vectors: candidates by a join on cells, ranked exactly; and an exact search that prunes by cell radii.

Cells are fitted on a bounded sample, all rows are assigned. A cell is stored in parts of bounded size, so one with a third of
all rows is many small groups. How many cells a query probes is measured when the index is built: as few as find ``RECALL`` of the true
neighbours of a sample of rows. A filter is applied to the rows of the probed cells, before the ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import vector as V
from ..sources.shared import shared_folder
from .search import _distances, _matrix, knn_join, ranked

#: Rows and bytes of the sample that the cells are fitted on, and rounds of the fit.
SAMPLE_ROWS, SAMPLE_BYTES, ROUNDS = 50_000, 64 << 20, 12
#: Cells at most, and bytes of their centres, which go to every task.
MOST_CELLS, CENTRE_BYTES = 16_384, 64 << 20
#: Rows of a cell in one part; queries that one part is compared with in one group.
PART_ROWS, QUERY_ROWS = 8192, 4096
#: Rows whose true neighbours are looked up to choose the number of probes, neighbours of each, and the share to find.
TUNE_ROWS, TUNE_K, RECALL = 256, 10, 0.97
#: Folders that the rows are written to by cell: a search reads those of its cells.
SHARDS = 64


@dataclass(frozen=True)
class Index:
    """A built index: its folder, metric, centres (a row a cell), radii and parts of the cells, and the probes of a query."""

    spark: SparkSession
    folder: str
    metric: str
    centres: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    probes: int
    recall: float
    schema: StructType

    def rows(self) -> DataFrame:
        """(id, vector, and the columns kept, cell, part, shard)."""
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")


def _placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors in the space of the cells: of length 1 for cosine, so that distances there order as the metric does."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows from centres."""
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T))


def fit_cells(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds from spread starts; a cell that loses its rows starts anew at a row that lies far off."""
    r = np.random.default_rng(7)
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.sort(r.permutation(len(distinct))[:n])]
    for _ in range(rounds):
        cell, gap = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for at in range(0, len(sample), 4096):
            g = _gaps(sample[at : at + 4096], centres)
            cell[at : at + 4096], gap[at : at + 4096] = g.argmin(1), g.min(1)
        order = np.argsort(cell, kind="stable")
        starts = np.searchsorted(cell[order], np.arange(len(centres)))
        counts = np.bincount(cell, minlength=len(centres))
        full = counts > 0
        centres = centres.copy()
        centres[full] = np.add.reduceat(sample[order], starts[full]) / counts[full, None]
        empty = np.flatnonzero(~full)
        centres[empty] = sample[np.argsort(-gap, kind="stable")[: len(empty)]]
    return centres


def build(corpus: DataFrame, metric: str = "cosine", cells: int | None = None, recall: float = RECALL, folder: str | None = None) -> Index:
    """An index of ``corpus(id, vector, ...)``, written to ``folder``; every row is in it, with all its columns.

    The sample is taken by hash of the id: at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes, whatever the corpus. Vectors have to be valid and of one length; an
    empty corpus gives an index that finds nothing. ``cells`` is by default the root of the number of rows.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark = corpus.sparkSession
    folder = folder or shared_folder(spark, "index")
    n, d = corpus.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    schema = StructType([*corpus.schema, *(StructField(c, IntegerType()) for c in ("cell", "part", "shard"))])
    if not n:
        spark.createDataFrame([], schema).write.parquet(f"{folder}/rows")
        return Index(spark, folder, metric, np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64), 0, 1.0, schema)
    by_hash = corpus.orderBy(F.xxhash64("id"), "id")
    sample = _placed(_matrix(by_hash.select("vector").limit(min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * d)))).toArrow().column(0).combine_chunks()), metric)
    wanted = cells or round(n**0.5)
    centres = fit_cells(sample, max(1, min(wanted, MOST_CELLS, CENTRE_BYTES // (8 * d))))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = _gaps(_placed(_matrix(batch.column(batch.schema.get_field_index("vector"))), metric), shared.value)
                cell = gaps.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(gaps[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "gap"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema)
    placed = corpus.mapInArrow(assign, f"{fields}, cell int, gap double")
    staged = f"{folder}/placed"
    placed.write.parquet(staged)
    placed = spark.read.parquet(staged)
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).toPandas()  # a row a cell
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    counts[sizes["cell"]], radii[sizes["cell"]] = sizes["n"], sizes["radius"]
    parts = -(-counts // PART_ROWS)
    several = {int(c): int(parts[c]) for c in np.flatnonzero(parts > 1)}
    split = F.lit(0)
    if several:
        table = spark.createDataFrame(list(several.items()), "c int, parts int")
        placed = placed.join(F.broadcast(table), F.col("cell") == F.col("c"), "left").drop("c")
        split = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))).cast("int")
    out = placed.withColumn("part", split).withColumn("shard", F.col("cell") % SHARDS)
    out.select(*corpus.columns, "cell", "part", "shard").repartition("shard", "cell", "part").sortWithinPartitions("shard", "cell", "part").write.partitionBy("shard").parquet(f"{folder}/rows")
    index = Index(spark, folder, metric, centres, radii, parts, len(centres), 1.0, schema)
    probes, found = _tuned(index, by_hash.select("id", "vector").limit(TUNE_ROWS), recall)
    return Index(spark, folder, metric, centres, radii, parts, probes, found, schema)


def _tuned(index: Index, rows: DataFrame, recall: float) -> tuple[int, float]:
    """(probes, share found): as few nearest cells as hold the wanted share of the true neighbours of ``rows``."""
    queries = rows.withColumnRenamed("id", "query_id")
    truth = knn_join(queries, index.rows().select("id", "vector"), TUNE_K + 1, index.metric)
    cells = index.rows().select(F.col("id").alias("i"), "cell")
    held = truth.where(F.col("id") != F.col("query_id")).join(cells, F.col("id") == F.col("i")).select("query_id", "cell").toPandas()  # at most TUNE_ROWS * TUNE_K
    if not len(held):
        return len(index.centres), 1.0
    own = rows.toPandas()
    gaps = _gaps(_placed(np.array(own["vector"].tolist(), np.float64), index.metric), index.centres)
    place = dict(zip(own["id"], gaps.argsort(1, kind="stable").argsort(1), strict=True))
    needed = np.sort([place[q][c] + 1 for q, c in zip(held["query_id"], held["cell"], strict=True)])
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return probes, float((needed <= probes).mean())


def _candidates(index: Index, asked: DataFrame, k: int, where: Column | None) -> DataFrame:
    """(query_id, id, distance): for each ``asked(query_id, vector, cells)`` the ``k`` nearest admitted rows of each part of its cells."""
    spark = index.spark
    probes = asked.select("query_id", F.col("vector").alias("q"), F.explode("cells").alias("c"))
    load = probes.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))
    sizes = spark.createDataFrame([(int(c), int(p)) for c, p in enumerate(index.parts) if p], "c int, parts int")
    cells = sizes.join(load, "c").select("c", "parts", "blocks")
    rows = index.rows().where(where) if where is not None else index.rows()
    # a group is a part of a cell with a block of the queries that probe the cell
    left = probes.join(F.broadcast(cells), "c").select("query_id", "q", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("b"))
    shards = cells.select((F.col("c") % SHARDS).alias("shard")).distinct()
    right = rows.join(F.broadcast(shards), "shard", "left_semi").join(F.broadcast(cells), F.col("cell") == F.col("c")).select("id", "vector", "c", F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    key, metric = ["c", "p", "b"], index.metric
    kinds = {f.name: f.dataType.simpleString() for f in (*asked.schema, *right.schema)}
    qtype = left.schema["query_id"].dataType

    def nearest(queries: pa.Table, found: pa.Table) -> pa.Table:
        names, ids, distances = [], [], []
        if queries.num_rows and found.num_rows:
            q, x = _matrix(queries.column("q").combine_chunks()), _matrix(found.column("vector").combine_chunks())
            q2, x2 = (q * q).sum(1), (x * x).sum(1)
            most = min(k, len(x))
            own, other = queries.column("query_id").to_pylist(), found.column("id")
            for at in range(0, len(q), 512):
                some = slice(at, at + 512)
                near = q[some] @ x.T
                near = 1 - near / np.sqrt(np.outer(q2[some], x2)) if metric == "cosine" else q2[some, None] + x2[None, :] - 2 * near
                cut = np.partition(near, most - 1, axis=1)[:, most - 1]
                room = 1e-7 * (1 + np.abs(q2[some]) if metric == "l2" else 1)
                i, j = np.nonzero(near <= (cut + room)[:, None])
                exact = _distances(q[some][i], x[j], metric)
                best: dict[int, list] = {}
                for a, e, name in zip(i.tolist(), exact.tolist(), other.take(pa.array(j)).to_pylist(), strict=True):
                    best.setdefault(a, []).append((e, name))
                for a, rows_ in best.items():
                    for e, name in sorted(rows_)[:k]:
                        names.append(own[at + a])
                        ids.append(name)
                        distances.append(e)
        return pa.table({"query_id": pa.array(names, queries.schema.field("query_id").type), "id": pa.array(ids, found.schema.field("id").type), "distance": pa.array(distances, pa.float64())})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(nearest, f"query_id {qtype.simpleString()}, id {kinds['id']}, distance double")


def _probing(index: Index, queries: DataFrame, chosen) -> DataFrame:
    """``queries`` with ``cells``, as ``chosen(distances from the centres, batch)`` gives them for each row."""
    shared = index.spark.sparkContext.broadcast(index.centres)
    metric = index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = _gaps(_placed(_matrix(batch.column(batch.schema.get_field_index("vector"))), metric), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen(gaps, batch), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{fields}, cells array<int>")


def probe(index: Index, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the ``k`` nearest of the rows in each query's nearest cells that ``where`` admits.

    ``queries(query_id, vector)`` may be as many as the corpus has rows. Distances are exact; neighbours in other cells are missed. With a filter a query can find fewer than ``k``.
    """
    n = probes or index.probes
    if not n:
        return ranked(queries.select("query_id").join(index.rows().select("id"), F.lit(False)).withColumn("distance", F.lit(0.0)), k)
    return ranked(_candidates(index, _probing(index, queries.select("query_id", "vector"), lambda gaps, _: gaps.argsort(1, kind="stable")[:, :n].tolist()), k, where), k)


def search(index: Index, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
    """As :func:`probe`, but exact: cells that may hold a nearer row than the ``k``-th found are read in a second round.

    A cell can't if the query lies farther from its centre than its radius and the distance found; queries with fewer than ``k`` rows have all cells read.
    """
    n = probes or index.probes
    first = probe(index, queries, k, where, n)
    if not n:
        return first
    first = first.drop("rank")
    folder = shared_folder(index.spark, "probe")
    first.write.parquet(folder)
    first = index.spark.read.parquet(folder)
    # the distance found, in the space of the cells
    reach = F.sqrt(2 * F.max("distance")) if index.metric == "cosine" else F.sqrt(F.max("distance"))
    bound = first.groupBy(F.col("query_id").alias("of")).agg(F.when(F.count(F.lit(1)) >= k, reach).alias("reach"))
    wide = queries.select("query_id", "vector").join(bound, F.col("query_id") == F.col("of"), "left").select("query_id", "vector", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    radii = index.radii

    def beyond(gaps: np.ndarray, batch: pa.RecordBatch) -> list[list[int]]:
        reach = batch.column(batch.schema.get_field_index("reach")).to_numpy()
        order = gaps.argsort(1, kind="stable")
        left = gaps - radii[None, :] <= reach[:, None] * (1 + 1e-9) + 1e-6
        return [[c for c in o[n:].tolist() if ok[c]] for o, ok in zip(order, left, strict=True)]

    rest = _candidates(index, _probing(index, wide, beyond), k, where)
    return ranked(first.unionByName(rest), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of ``truth(query_id, id)`` among ``found(query_id, id)``; null without truth."""
    hit = found.select(F.col("query_id").alias("q"), F.col("id").alias("i"), F.lit(1).alias("hit"))
    return truth.join(hit, (F.col("query_id") == F.col("q")) & (F.col("id") == F.col("i")), "left").agg(F.try_divide(F.count("hit"), F.count(F.lit(1))).alias("recall"))
