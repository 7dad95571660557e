"""Filtered exact nearest-neighbour search, copy collapsing and ranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as T
from ..functions import vector as V
from ..functions.constants import CANDIDATES, MAX_LIMIT

#: Bytes of query vectors and of what a task keeps for them in a block that is broadcast; more queries are answered block by block.
QUERY_BYTES = 32 << 20
#: Corpus rows that are compared with as many queries at once.
ROWS = 1024
#: Pairs whose exact distances are taken at once; rows of a result batch.
PAIRS = 1 << 14


@dataclass(frozen=True)
class SearchFilter:
    """What a search admits: source, entries (None: any), sessions (None: any), and tokens that the statement mentions."""

    source: str = "all"
    entries: frozenset[str] | None = None
    sessions: frozenset[str] | None = None
    mentions: tuple[str, ...] = ()

    def __post_init__(self):
        if self.source not in ("all", "distribution", "contributed"):
            raise ValueError(f"unknown source: {self.source}")
        if self.entries is not None and self.source == "distribution":
            raise ValueError("entries can't be chosen within the distribution")
        if any(not x for x in (*(self.entries or ()), *(self.sessions or ()))):
            raise ValueError("empty name")
        if any(not x or any(c.isspace() for c in x) for x in self.mentions):
            raise ValueError("a mention is a token without white space")

    def prefilter(self, entry: Column, exclude: str = "") -> Column:
        """Before the search: by source and entry. The distribution has the empty entry; no entries means none of the others."""
        ok = {"all": F.lit(True), "distribution": entry == "", "contributed": entry != ""}[self.source]
        if self.entries is not None:
            chosen = entry.isin(*sorted(self.entries)) if self.entries else F.lit(False)
            ok = chosen if self.source == "contributed" else chosen | (entry == "")
        return ok & (entry != exclude) if exclude else ok

    def admits(self, session: Column, source: Column) -> Column:
        """After it, on the nearest only: by session and mentions in the statement."""
        ok = F.lit(True) if self.sessions is None else session.isin(*sorted(self.sessions)) if self.sessions else F.lit(False)
        if self.mentions:
            said = T.statement(source)
            for token in self.mentions:
                ok = ok & T.mentions(said, token)
        return ok

    def restrict(self, entries: Iterable[str] | None, sessions: Iterable[str] | None) -> SearchFilter:
        """Only what is also among the given names."""
        both = lambda mine, given: mine if given is None else frozenset(given) if mine is None else mine & frozenset(given)
        return SearchFilter(self.source, both(self.entries, entries), both(self.sessions, sessions), self.mentions)

    def parameters(self) -> dict[str, str]:
        out = {} if self.source == "all" else {"source": self.source}
        for key in ("entries", "sessions"):
            if getattr(self, key) is not None:
                out[key] = ",".join(sorted(getattr(self, key)))
        return out | ({"mentions": " ".join(self.mentions)} if self.mentions else {})

    @staticmethod
    def of(parameters: dict[str, str]) -> SearchFilter:
        names = lambda key: None if key not in parameters else frozenset(x for x in parameters[key].split(",") if x)
        return SearchFilter(parameters.get("source", "all"), names("entries"), names("sessions"), tuple(parameters.get("mentions", "").split()))


def check_request(query: str, limit: int) -> None:
    if not query.strip():
        raise ValueError("blank query")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")


def nearest(corpus: DataFrame, vector: list[float], k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The ``k`` nearest rows with ``distance``, ordered by distance and id.

    The ranking reads ids and vectors only; the records of the ``k`` found are joined back, so wide ones are read for them alone. A
    filter put on the result sees these rows, however far it is pushed down.
    """
    spark = corpus.sparkSession
    query = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, vector array<double>")
    near = knn_join(query, corpus.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), k, metric)
    near = near.select(F.col("id").alias(id_col), "distance")
    return corpus.join(F.broadcast(near), id_col).orderBy("distance", id_col)


def _matrix(column: pa.Array) -> np.ndarray:
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.float64).reshape(len(column), -1)


def _distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of rows of ``q`` and ``c`` one by one: the same for equal vectors wherever they stand."""
    if metric == "l2":
        return ((q - c) ** 2).sum(1)
    return np.maximum(0.0, 1 - (q * c).sum(1) / np.sqrt((q * q).sum(1) * (c * c).sum(1)))


def _nearness(q: np.ndarray, q2: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``q`` and ``c`` by one product, up to its rounding; few arrays of this size at a time."""
    near, c2 = q @ c.T, (c * c).sum(1)
    if metric == "l2":
        near *= -2
        near += q2[:, None]
        near += c2[None, :]
        return near
    near /= np.sqrt(np.outer(q2, c2))
    return np.subtract(1, near, out=near)


class Best:
    """The ``k`` first hits of each of ``n`` queries by (distance, id), as arrays."""

    def __init__(self, n: int, k: int):
        self.k, self.distance, self.count, self.names = k, np.full((n, k), np.inf), np.zeros(n, np.int64), None

    def worst(self, few: slice) -> np.ndarray:
        return self.distance[few, -1]

    def take(self, query: np.ndarray, distance: np.ndarray, name: pa.Array) -> None:
        """More hits; ``query`` ascends."""
        names = name.to_numpy(zero_copy_only=False)
        if self.names is None:
            self.kind, self.names = name.type, np.zeros(self.distance.shape, names.dtype)
        touched = np.unique(query)
        old_q, old_at = np.nonzero(np.arange(self.k) < self.count[touched, None])
        old_q = touched[old_q]
        query = np.concatenate((old_q, query))
        distance = np.concatenate((self.distance[old_q, old_at], distance))
        names = np.concatenate((self.names[old_q, old_at], names))
        order = np.lexsort((np.unique(names, return_inverse=True)[1], distance, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, place = order[place < self.k], query[place < self.k], place[place < self.k]
        self.distance[query, place], self.names[query, place] = distance[order], names[order]
        self.count[touched] = np.bincount(query, minlength=len(self.count))[touched]

    def rows(self, query_id: pa.Array) -> Iterator[pa.RecordBatch]:
        query, place = np.nonzero(np.arange(self.k) < self.count[:, None])
        for s in range(0, len(query), PAIRS):
            i, at = query[s : s + PAIRS], place[s : s + PAIRS]
            yield pa.RecordBatch.from_arrays([query_id.take(pa.array(i)), pa.array(self.names[i, at], self.kind), pa.array(self.distance[i, at])], ["query_id", "id", "distance"])


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", exclude: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, id, distance, rank): each query's ``k`` nearest corpus rows by (distance, id).

    ``queries(query_id, vector, ...)`` are the small side and come to the workers in blocks of bounded size; ``corpus(id,
    vector, ...)`` is scanned once a block and never shuffled, only its tasks' ``k`` best a query are. ``exclude`` names
    a query column and a corpus column: rows in which they are equal don't count. Vectors have to be valid.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric: {metric}")
    spark = corpus.sparkSession
    carried = ["query_id", "vector", *([exclude[0]] if exclude and exclude[0] != "query_id" else [])]
    n, size = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * ((size or 1) * 8 + k * 64) // QUERY_BYTES))  # a hit is some 64 bytes with what sorting takes
    columns = ["id", "vector", *([exclude[1]] if exclude and exclude[1] not in ("id", "vector") else [])]
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("id", corpus.schema["id"].dataType), StructField("distance", DoubleType())])
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        some = queries.select(*carried)
        if blocks > 1:
            some = some.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        block = some.toArrow().combine_chunks()
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = _matrix(shared.value.column("vector").combine_chunks())
            q2 = (q * q).sum(1)
            own = shared.value.column(exclude[0]).to_pylist() if exclude else None
            best = Best(len(q), k)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    c, names = _matrix(part.column(1)), part.column(0)
                    other = part.column(part.schema.get_field_index(exclude[1])).to_pylist() if exclude else None
                    index: dict = {}
                    for j, x in enumerate(other or ()):
                        index.setdefault(x, []).append(j)
                    for first in range(0, len(q), ROWS):
                        few = slice(first, first + ROWS)
                        near = _nearness(q[few], q2[few], c, metric)
                        for i, x in enumerate(own[few] if exclude else ()):
                            near[i, index.get(x, [])] = np.inf
                        # candidates by the fast product, with room for its rounding; then distances one by one
                        room = 1e-7 * (1 + q2[few, None] if metric == "l2" else 1)
                        most = min(k, near.shape[1]) - 1
                        cut = np.minimum(best.worst(few), np.partition(near, most, axis=1)[:, most])
                        i, j = np.nonzero((near <= cut[:, None] + room) & np.isfinite(near))
                        if len(i):
                            del near
                            exact = np.concatenate([_distances(q[first + i[s : s + PAIRS]], c[j[s : s + PAIRS]], metric) for s in range(0, len(i), PAIRS)])
                            best.take(first + i, exact, names.take(pa.array(j)))
            yield from best.rows(shared.value.column("query_id").combine_chunks())

        found = found.unionByName(corpus.select(*columns).mapInArrow(run, schema))
    return ranked(found, k)


def places(queries: DataFrame, corpus: DataFrame, metric: str = "cosine", digits: int = 9) -> DataFrame:
    """(query_id, rank): where a row with each query's ``own`` id and ``distance`` would stand among ``corpus(id, vector)`` by (distance, id), its own row left out.

    ``queries(query_id, vector, own, distance)``. Tasks count the nearer rows, so a query costs a number a task, however far down it stands; distances are compared rounded to ``digits``.
    """
    n, size = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, -(-n * (size or 1) * 8 // QUERY_BYTES))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("nearer", LongType())])
    found = None
    for b in range(blocks):
        some = queries.select("query_id", "vector", "own", "distance").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        shared = corpus.sparkSession.sparkContext.broadcast(some.toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            if not asked.num_rows:
                return
            q = _matrix(asked.column("vector").combine_chunks())
            own, limit = asked.column("own").to_numpy(), np.round(asked.column("distance").to_numpy(), digits)
            nearer = np.zeros(len(q), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    c, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                    for i in range(len(q)):
                        d = np.round(_distances(q[i : i + 1], c, metric), digits)
                        nearer[i] += int(((ids != own[i]) & ((d < limit[i]) | ((d == limit[i]) & (ids < own[i])))).sum())
            yield pa.RecordBatch.from_arrays([asked.column("query_id").combine_chunks(), pa.array(nearer)], ["query_id", "nearer"])

        part = corpus.select("id", "vector").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("query_id").agg((F.sum("nearer") + 1).cast("int").alias("rank"))


def ranked(found: DataFrame, k: int | None = None, by: tuple[str, ...] = ("distance", "id")) -> DataFrame:
    """``rank`` within each query; with ``k`` only the first so many."""
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    return out if k is None else out.where(F.col("rank") <= k)


def merge_targets(parts: list[DataFrame], k: int) -> DataFrame:
    """One ranking of several targets' rankings: all, by distance and id, the first ``k``."""
    out = parts[0].drop("rank")
    for p in parts[1:]:
        out = out.unionByName(p.drop("rank"))
    return ranked(out, k)


def search(corpus: DataFrame, vector: list[float], limit: int, admit: SearchFilter = SearchFilter(), metric: str = "cosine", exclude: str = "", collapse_copies: bool = False, candidates: int = CANDIDATES) -> DataFrame:
    """A search over ``corpus(id, entry, session, src, vector, ...)``: prefilter, exact top-k, post-filter, copies, limit.

    The post-filter sees the max(limit, candidates) nearest only, so fewer than ``limit`` can be left.
    """
    found = nearest(corpus.where(admit.prefilter(F.col("entry"), exclude)), vector, max(limit, candidates), metric)
    found = found.where(admit.admits(F.col("session"), F.col("src"))).drop("vector", "embedding_input", "description_artifact")
    if collapse_copies:
        return collapse(found.withColumn("query_id", F.lit(0)).withColumn("key", T.statement(F.col("src"))), limit, ("distance", "id")).drop("query_id")
    return found.orderBy("distance", "id").limit(limit)


def collapse_members(hits: DataFrame, limit: int, by: tuple[str, ...] = ("rank",)) -> DataFrame:
    """(query_id, place, copy, and the hit's columns but ``key``): hits of each ``query_id`` with equal ``key`` share a place, a row a hit.

    Groups stand in the order of their first hit. The scan ends at the hit that would open group ``limit`` + 1, so copies
    after that aren't attached. Copy 0 represents its group: its first hit with an empty ``entry``, or its first; the others are numbered in order. Keys are
    compared by a hash of 256 bits, which goes in their place. Only keys with their first place are ranked, and the hits of the chosen ones
    joined to them; a group of any size is rows that are sorted, never an array.
    """
    columns = [c for c in hits.columns if c not in ("query_id", "key")]
    order = F.struct(*by)
    slim = hits.select("query_id", *columns, F.when(F.col("key").isNotNull(), F.unhex(F.sha2(F.col("key").cast("string"), 256))).alias("_hash"), order.alias("_by"))
    first = slim.groupBy("query_id", "_hash").agg(F.min("_by").alias("_first"))
    placed = first.withColumn("_group", F.row_number().over(Window.partitionBy("query_id").orderBy("_first"))).where(F.col("_group") <= limit + 1)
    stop = placed.where(F.col("_group") == limit + 1).select(F.col("query_id").alias("_of"), F.col("_first").alias("_stop"))
    chosen = placed.where(F.col("_group") <= limit).join(stop, F.col("query_id").eqNullSafe(F.col("_of")), "left").select(F.col("query_id").alias("_query"), F.col("_hash").alias("_key"), "_group", "_stop")
    few = slim.join(chosen, F.col("query_id").eqNullSafe(F.col("_query")) & F.col("_hash").eqNullSafe(F.col("_key")))
    few = few.where(F.col("_stop").isNull() | (F.col("_by") < F.col("_stop")))
    own = F.min(F.struct((F.col("entry") != "").cast("int").alias("o"), F.col("_by").alias("b")))
    heads = few.groupBy(F.col("query_id").alias("_q"), F.col("_group").alias("_g")).agg(own.alias("_head"))
    marked = few.join(heads, F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("_group") == F.col("_g")))
    place = Window.partitionBy("query_id", "_group").orderBy((F.col("_by") != F.col("_head.b")).cast("int"), "_by")
    return marked.select("query_id", F.col("_group").alias("place"), (F.row_number().over(place) - 1).alias("copy"), *columns)


def collapse(hits: DataFrame, limit: int, by: tuple[str, ...] = ("rank",)) -> DataFrame:
    """:func:`collapse_members` as one row a group, with the others nested under ``copies``: for the hits of a search, which are few."""
    columns = [c for c in hits.columns if c not in ("query_id", "key")]
    rows = collapse_members(hits, limit, by)
    groups = rows.groupBy("query_id", "place").agg(F.array_sort(F.collect_list(F.struct("copy", *columns))).alias("h"))
    head, rest = F.col("h")[0], F.slice("h", 2, F.size("h"))
    return groups.select("query_id", "place", *(head[c].alias(c) for c in columns), F.transform(rest, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("copies"))


def with_local_lines(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Left join of ``files(file, local_file, content)``: ``local_file``, and the line of the occurrence nearest to ``start_line``."""
    from ..functions.arrow import nearest_line

    out = hits.join(files, "file", "left")
    return out.withColumn("local_line", nearest_line("content", "src", "start_line")).drop("content")


def trusted_files(hits: DataFrame, roots: list[str], files: DataFrame) -> DataFrame:
    """Hits whose ``file`` starts with an allowed root, has plain elements only, and is among ``files(file)``."""
    plain = F.col("file").rlike(r"^[^$~\\]+$") & ~F.col("file").rlike(r"(^|/)\.\.?(/|$)|//")
    under = F.lit(False)
    for r in roots:
        under = under | F.startswith(F.col("file"), F.lit(r.rstrip("/") + "/"))
    return hits.where(plain & under).join(files.select("file"), "file", "left_semi")


def numbered_lines(text: Column) -> Column:
    """(line number from 1, line) structs of a text."""
    return F.transform(F.split(text, "\n", -1), lambda x, i: F.struct((i + 1).alias("number"), x.alias("line")))


def most_available(copies: DataFrame, availability: DataFrame, least: int = 0) -> DataFrame:
    """Of each ``result_id``, the copy of the most available session, the first (``ord``) of equals; none below ``least``."""
    levels = copies.join(availability, "session", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    best = levels.groupBy("result_id").agg(F.max_by(F.struct(*levels.columns), F.struct(F.col("level"), -F.col("ord"))).alias("b"))
    return best.select("b.*").where(F.col("level") >= least)
