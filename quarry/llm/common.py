"""What the operators of this subpackage share: the shared folder, Arrow batches cut by size, and vectorised word hashing.

Hashes are 64 bits wide and made from bytes by numpy alone, so that a batch of documents is
hashed in a few passes over one buffer and nothing is done per word in Python.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at once; a longer single text is a pass of its own.
CHUNK_BYTES = 1 << 20
#: Rows of a few numbers up to which a side is broadcast (some 150 bytes each in the driver, and several at a time); with more it is shuffled.
BROADCAST_ROWS = 100_000

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """URI of a new folder, not yet made, below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, a temporary folder takes its place for the life of
    the session on one machine (``local`` masters), and anywhere else ``ValueError`` is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends here and lost executors cost only their running tasks."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system, whichever that is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the Arrow operators read, under fixed names; other columns are pruned at the scan."""
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_hash(text_col: str = "text") -> Column:
    """64-bit hash of the text (null: empty): with the id it tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def without_rows(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """``documents`` without the rows whose id and text hash stand in ``gone(doc_id, t)``; no column name can clash."""
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("t")).alias("own"))
    of = gone.select(F.struct("doc_id", "t").alias("of"))
    return rows.join(F.broadcast(of) if gone.count() <= BROADCAST_ROWS else of, F.col("own") == F.col("of"), "left_anti").select(*(F.col("row")[c].alias(c) for c in documents.columns))


def split_batches(batches: Iterable[pa.RecordBatch], text_col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold at most ``limit`` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(batch.column(batch.schema.get_field_index(text_col)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def text_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; a null counts as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _M2
    h = h ^ (h >> _U(27))
    h = h * _M3
    return h ^ (h >> _U(31))


_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _M1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE_OF_LOWER = _BYTE_VALUE[LOWER]
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
        done += step
    return out


class _Powers:
    up = _powers(_BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << int(n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def word_spans(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word: the maximal runs of bytes that ``word`` marks (by default all but ASCII white space), none across rows."""
    inside = ~SPACE[buf] if word is None else word[buf]
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span; A-Z count as a-z if ``lower``."""
    up, down = _Powers.upto(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_VALUE_OF_LOWER if lower else _BYTE_VALUE)[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M1)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``k`` words in a row, repeats included; a row with fewer words, but some, has one shingle of all."""
    n = len(words)
    counts = np.bincount(rows, minlength=n_rows)
    out_rows, out = [], []
    if n >= k:
        whole = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
        h = words[whole]
        for j in range(1, k):
            h = h * _M1 + words[whole + j]
        out.append(mix(h + _U(k)))
        out_rows.append(rows[whole])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        ends = np.cumsum(counts)
        for r in short:
            h = _U(0)
            with np.errstate(over="ignore"):
                for w in words[ends[r] - counts[r] : ends[r]]:
                    h = h * _M1 + w
                h = h + _U(int(counts[r]))
            out.append(mix(np.array([h], np.uint64)))
            out_rows.append(np.array([r], np.int64))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out)


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct hashes of each row, ascending within it."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        keep = np.ones(len(rows), bool)
        keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[keep], hashes[keep]
    return np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows)))).astype(np.int64), hashes


def shingle_sets(batch: pa.RecordBatch, k: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): each row's set of word ``k``-shingles, A-Z lowered, words being runs without ASCII white space."""
    buf, offsets = text_offsets(batch.column(batch.schema.get_field_index(text_col)))
    start, end, rows = word_spans(buf, offsets)
    r, h = shingle_hashes(word_hashes(buf, start, end), rows, k, batch.num_rows)
    return distinct_by_row(r, h, batch.num_rows)
