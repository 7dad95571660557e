"""Files that tasks read and write: byte ranges, digests of chunks, copies, and a data source of records with their vectors.

The driver sees names, sizes and counts; bytes pass through tasks only. Paths are URIs of any store that Arrow's file systems open on
the executors (mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .shared import Files, uri

#: Bytes of a file that are digested, counted or read in one go.
CHUNK_BYTES = 32 << 20
#: Bytes and rows of a batch of records.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
#: Bytes of a batch that are made into lines at once: Python's copies of them take several times that.
SLICE_BYTES = 1 << 20


def local_path(at: str) -> str | None:
    """The path of a file URI or a plain path; None for other stores. As in Hadoop's paths, nothing in it is an escape."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*:", at):
        return at
    m = re.match(r"file:(?://[^/]*)?(/.*)$", at, re.S)
    return m[1] if m else None


def _store(at: str) -> tuple[pafs.FileSystem, str]:
    path = local_path(at)
    if path is not None:
        return pafs.LocalFileSystem(), path
    root, rest = re.match(r"([^:]+://[^/]*)/*(.*)$", at, re.S).groups()
    store, base = pafs.FileSystem.from_uri(f"{root}/")
    return store, f"{base.rstrip('/')}/{rest}"


def opened(at: str) -> pa.NativeFile:
    store, path = _store(at)
    return store.open_input_file(path)


def create(at: str):
    store, path = _store(at)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def _pieces(f: pa.NativeFile, start: int, length: int) -> Iterator[bytes]:
    f.seek(start)
    while length > 0 and (data := f.read(min(length, 1 << 20))):
        length -= len(data)
        yield data


def chunks(spark: SparkSession, files: list[tuple[str, int]], size: int | None = None) -> DataFrame:
    """(file, chunk, start, length): the chunks of ``files``, names with bytes; an empty file has one empty chunk."""
    step = size or CHUNK_BYTES
    table = spark.createDataFrame(files, "file string, bytes long").repartition(max(1, min(len(files), 1024)))
    each = table.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("bytes") / F.lit(step)) - 1))).alias("chunk"))
    return each.select("file", "chunk", (F.col("chunk") * step).alias("start"), F.least(F.lit(step), F.col("bytes") - F.col("chunk") * step).alias("length"))


def digests(folder: str, pieces: DataFrame) -> DataFrame:
    """``pieces(file, chunk, start, length)`` with the SHA-256 of each as tasks read it; of a file that is missing or too short, the hash is null."""
    base = uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                h, n = hashlib.sha256(), 0
                try:
                    with opened(f"{base}/{name}") as f:
                        for data in _pieces(f, start, length):
                            h.update(data)
                            n += len(data)
                except FileNotFoundError:
                    n = -1
                out.append(h.hexdigest() if n == length else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "chunk", "start", "length")), pa.array(out, pa.string())], ["file", "chunk", "start", "length", "sha256"])

    return pieces.select("file", "chunk", "start", "length").repartition("file", "chunk").mapInArrow(run, "file string, chunk long, start long, length long, sha256 string")


def roots(found: DataFrame) -> DataFrame:
    """(file, bytes, root): the SHA-256 of the digests of a file's chunks in order."""
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda x: F.coalesce(x.sha256, F.lit("-"))), "\n")
    return found.groupBy("file").agg(F.sum("length").alias("bytes"), F.sha2(each, 256).alias("root"))


def root_of(found: DataFrame) -> str:
    """One digest over all files' roots in order of their names: a row a file comes together."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("file", "root"))), lambda x: F.concat_ws(" ", x.file, x.root))
    return roots(found).agg(F.sha2(F.array_join(lines, "\n"), 256)).first()[0]


def faults(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(file, chunk, fault) of chunks that differ: ``changed``, ``missing`` or ``extra``."""
    a, b = expected.select("file", "chunk", F.col("sha256").alias("want")), found.select(F.col("file").alias("f"), F.col("chunk").alias("c"), F.col("sha256").alias("have"))
    both = a.join(b, (F.col("file") == F.col("f")) & (F.col("chunk") == F.col("c")), "full")
    fault = F.when(F.col("file").isNull(), "extra").when(F.col("f").isNull() | F.col("have").isNull(), "missing").when(F.col("want") != F.col("have"), "changed")
    return both.select(F.coalesce("file", "f").alias("file"), F.coalesce("chunk", "c").alias("chunk"), fault.alias("fault")).where("fault IS NOT NULL")


def whole_digests(spark: SparkSession, folder: str, names: list[str]) -> dict[str, str]:
    """The plain SHA-256 of each file, as other writers' manifests have it; it can't be had in parts, so a task reads a file from end to end."""
    files = Files(spark, folder)
    base, sizes = uri(folder), {n: s for n, s in files.walk()}
    rows = spark.createDataFrame([(n, 0, 0, sizes.get(n, 0)) for n in names], "file string, chunk long, start long, length long").repartition(max(1, len(names)))
    return {r.file: r.sha256 for r in digests(base, rows).collect()}


def copied(spark: SparkSession, source: str, target: str, files: list[tuple[str, int]]) -> int:
    """Copy files by tasks, each under a name of its own attempt and then by a rename; returns their bytes."""
    a, b = uri(source), uri(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                temp = f"{b}/{name}.{uuid.uuid4().hex}"
                with opened(f"{a}/{name}") as f, create(temp) as out:
                    for data in _pieces(f, 0, size):
                        out.write(data)
                        n += len(data)
                store, path = _store(temp)
                store.move(path, _store(f"{b}/{name}")[1])
            yield pa.RecordBatch.from_pydict({"n": [n]})

    rows = spark.createDataFrame(files, "file string, bytes long").repartition(max(1, min(len(files), 1024)))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_files(rows: DataFrame, folder: str) -> int:
    """Write ``rows(name, text)`` as a file each, by tasks; returns how many."""
    base = uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                temp = f"{base}/.{name}.{uuid.uuid4().hex}"
                with create(temp) as out:
                    out.write(text.encode())
                store, path = _store(temp)
                store.move(path, _store(f"{base}/{name}")[1])
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("name", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(name, text): the files of a folder that end in ``suffix``, whole, by Spark's reader; the name is without it."""
    rows = spark.read.option("pathGlobFilter", f"*{suffix}").text(uri(folder), wholetext=True)
    name = F.url_decode(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -1), F.lit("+"), F.lit("%2B")))  # paths stand there as URIs
    return rows.select(F.left(name, F.char_length(name) - len(suffix)).alias("name"), F.col("value").alias("text"))


# --- records and vectors --------------------------------------------------------------------------------------------------


def line_ranges(spark: SparkSession, at: str, size: int, step: int | None = None) -> list[tuple[int, int, int, int]]:
    """(start, end, first, count): ranges of a file of lines, how many lines begin in each, and the number of the first of these.

    Tasks count; a row a range comes to the driver, which adds them up.
    """
    length = step or CHUNK_BYTES
    name = uri(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(name) as f:
            for batch in batches:
                starts, counts = batch.column(0).to_pylist(), []
                for start in starts:
                    end, n = min(start + length, size), int(start == 0)
                    for data in _pieces(f, max(0, start - 1), end - 1 - max(0, start - 1)):  # a line begins after each of these newlines
                        n += data.count(b"\n")
                    counts.append(n)
                yield pa.RecordBatch.from_pydict({"start": starts, "n": counts})

    found = sorted(tuple(r) for r in spark.range(0, size, length, max(1, min(1024, -(-size // length)))).mapInArrow(run, "start long, n long").collect()) if size else []
    out, first = [], 0
    for start, n in found:
        out.append((start, min(start + length, size), first, n))
        first += n
    return out


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file of records, ``count`` from number ``first``; their vectors begin at row ``row`` of another file."""

    records: str
    start: int
    end: int
    first: int
    count: int
    vectors: str
    row: int


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.columns, self.dimension = schema.fieldNames(), int(options.get("dimension", 0))
        if unknown := set(self.columns) - {"ord", "record", "vector"}:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        self.plan = [Range(*x) for x in json.loads(options["plan"])]

    def partitions(self) -> list[Range]:
        return [r for r in self.plan if r.count] or [Range("", 0, 0, 0, 0, "", 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        wide = self.dimension * 4
        vectors = opened(part.vectors) if "vector" in self.columns else None
        try:
            at = 0
            for lines, n in self._lines(part) if "record" in self.columns else ((None, min(BATCH_ROWS, part.count - i)) for i in range(0, part.count, BATCH_ROWS)):
                columns = {}
                if "ord" in self.columns:
                    columns["ord"] = pa.array(np.arange(part.first + at, part.first + at + n))
                if lines is not None:
                    columns["record"] = pa.array(lines, pa.string())
                if vectors is not None:
                    data = b"".join(_pieces(vectors, (part.row + at) * wide, n * wide))
                    if len(data) != n * wide:
                        raise ValueError("the vector file is too short")
                    columns["vector"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.dimension), pa.array(np.frombuffer(data, "<f4")))
                at += n
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], self.columns)
        finally:
            if vectors is not None:
                vectors.close()

    def _lines(self, part: Range) -> Iterator[tuple[list[str], int]]:
        """Lines in batches. A range's first bytes up to a newline belong to the line before."""
        left, some, size = part.count, [], 0
        with opened(part.records) as f:
            f.seek(max(0, part.start - 1))
            skip, rest = part.start > 0, b""
            while left:
                data = f.read(1 << 20)
                if not data:
                    some.append(rest.removesuffix(b"\r").decode())  # the last line has no newline
                    left -= 1
                    break
                *whole, rest = (rest + data).split(b"\n")
                if skip and whole:
                    whole, skip = whole[1:], False
                elif skip:
                    rest = b""
                for line in whole[:left]:
                    some.append(line.removesuffix(b"\r").decode())
                    size += len(line)
                    if size >= BATCH_BYTES or len(some) >= BATCH_ROWS:
                        yield some, len(some)
                        some, size = [], 0
                left -= min(left, len(whole))
        if some:
            yield some, len(some)


class RecordSource(DataSource):
    """``spark.read.format("quarry_records")``: (ord, record, vector) by a plan of ranges.

    A schema with some of the three columns only reads what they need: no vectors for records, no records for vectors.
    """

    @classmethod
    def name(cls) -> str:
        return "quarry_records"

    def schema(self) -> str:
        return "ord long, record string, vector array<float>"

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options, schema)


def read_ranges(spark: SparkSession, plan: list[Range], dimension: int, columns: tuple[str, ...] = ("ord", "record", "vector")) -> DataFrame:
    kinds = {"ord": "long", "record": "string", "vector": "array<float>"}
    spark.dataSource.register(RecordSource)
    rows = [[r.records, r.start, r.end, r.first, r.count, r.vectors, r.row] for r in plan]
    return spark.read.format("quarry_records").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).option("dimension", dimension).option("plan", json.dumps(rows)).load()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows of (ord, record, vector) in slices of at most ``SLICE_BYTES`` and ``BATCH_ROWS`` rows, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy() + 4 * pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))), at + BATCH_ROWS)
            yield batch.slice(at, to - at)
            at = to


_PART = "first long, name string, count long, record_bytes long, vector_bytes long, record_sha256 string, vector_sha256 string"


def write_parts(rows: DataFrame, base: str, parts: int | None = None) -> list[dict]:
    """Write ``rows(ord, record, vector)`` in order as parts below ``base``: a task a range, each part a file of lines and one of floats.

    Returns the part table, in order, with prefix sums: ``at`` is the number of records before, ``record_at`` and ``vector_at`` the bytes. A repeated task
    writes under another name; the table has those that count, and others are deleted. ``parts`` is their number, by default Spark's choice by size.
    """
    folder = uri(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, first, lengths, sums = f"part-{uuid.uuid4().hex}", 0, None, [0, 0], [hashlib.sha256(), hashlib.sha256()]
        with create(f"{folder}/{name}.jsonl") as records, create(f"{folder}/{name}.f32") as vectors:
            for batch in _slices(batches):
                first = batch.column(0)[0].as_py() if first is None else first
                one = batch.column(2)
                ends = one.offsets.to_numpy()
                lines = b"".join(x.encode() + b"\n" for x in batch.column(1).to_pylist())
                floats = one.values[ends[0] : ends[-1]].to_numpy(zero_copy_only=False).astype("<f4", copy=False).tobytes()
                for i, (out, data) in enumerate(((records, lines), (vectors, floats))):
                    out.write(data)
                    sums[i].update(data)
                    lengths[i] += len(data)
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"first": [first], "name": [name], "count": [n], "record_bytes": [lengths[0]], "vector_bytes": [lengths[1]], "record_sha256": [sums[0].hexdigest()], "vector_sha256": [sums[1].hexdigest()]})

    ranges = rows.select(F.col("ord").cast("long"), "record", F.col("vector").cast("array<float>"))
    ranges = (ranges.repartitionByRange(parts, "ord") if parts else ranges.repartitionByRange("ord")).sortWithinPartitions("ord")
    found = sorted((r.asDict() for r in ranges.mapInArrow(run, _PART).collect()), key=lambda p: p["first"])
    at = record_at = vector_at = 0
    for p in found:
        p |= {"at": at, "record_at": record_at, "vector_at": vector_at}
        at, record_at, vector_at = at + p["count"], record_at + p["record_bytes"], vector_at + p["vector_bytes"]
    files, kept = Files(rows.sparkSession, folder), {p["name"] for p in found}
    for name in files.names():
        if name.startswith("part-") and name.rsplit(".", 1)[0] not in kept:
            files.remove(name)
    return found


def put_together(spark: SparkSession, base: str, parts: list[dict], targets: dict[str, str]) -> None:
    """Parts at their places in single files (extension to name): tasks write at offsets, so the folder has to be mounted; the parts go."""
    folder = local_path(uri(base))
    if folder is None:
        raise ValueError("single files are put together in a mounted folder only; elsewhere parts are the layout")
    for end, target in targets.items():
        kind = "record" if end == "jsonl" else "vector"
        with open(os.path.join(folder, target), "wb") as f:
            f.truncate(sum(p[f"{kind}_bytes"] for p in parts))
        rows = [(f"{p['name']}.{end}", p[f"{kind}_at"], p[f"{kind}_bytes"]) for p in parts]

        def run(batches: Iterator[pa.RecordBatch], target=target) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    with opened(os.path.join(folder, name)) as f, open(os.path.join(folder, target), "r+b") as out:
                        out.seek(at)
                        for data in _pieces(f, 0, size):
                            out.write(data)
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

        if rows:
            spark.createDataFrame(rows, "name string, at long, bytes long").repartition(min(len(rows), 1024)).mapInArrow(run, "n long").agg(F.sum("n")).collect()
        for name, *_ in rows:
            os.unlink(os.path.join(folder, name))
