"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are small sets of word shingles, documents large ones, so it is the item that gets a MinHash sketch:
the shingles of its set with the least hashes. Items are partitioned by set size, and a partition's
sketches all have the length that its largest size needs: an item of n shingles that is contained to
at least t misses at most n - ceil(t n) of them, so one more of them than that can't all be missing and a document that holds
none of the sketch is no candidate. A document whose whole set is smaller than t times a partition's least size skips the
partition. Nothing is left to chance by this: candidates lose no match, and each is verified by counting its
shingles themselves, word by word.

Items come to the workers in blocks of bounded size; with a larger benchmark there are more passes over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import shingle_hashes, split_batches, text_offsets, word_hashes, word_spans

#: Bytes of test items in a block that is broadcast.
BLOCK_BYTES = 32 << 20
#: Words are runs of letters and digits of lowered text; all that isn't ASCII counts as a letter.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_WORD_TEXT = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _words(text: str) -> list[str]:
    return _WORD_TEXT.findall(text)


def _shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@dataclass
class Partition:
    """Items whose shingles have ``k`` words and whose sets have from ``least`` to under 2 * ``least`` of them."""

    k: int
    least: int
    hashes: np.ndarray  # of all sketches, ascending
    owners: np.ndarray  # the item that each belongs to


class Sketches:
    """The sketches of a block of items, by partition, and the items' shingles."""

    def __init__(self, items: list[tuple[int, str]], k: int, percent: int):
        self.ids = [i for i, _ in items]
        lowered = pc.utf8_lower(pa.array([t or "" for _, t in items], pa.string()))
        words = [_words(t) for t in lowered.to_pylist()]
        # an item of fewer words than k is one shingle of all its words
        self.k = [min(k, len(w)) for w in words]
        self.shingles = [_shingles(w, n) if n else set() for w, n in zip(words, self.k, strict=True)]
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        buf, offsets = text_offsets(lowered)
        start, end, rows = word_spans(buf, offsets, _WORD)
        hashes = word_hashes(buf, start, end)
        for n in sorted({n for n in self.k if n}):
            at, h = shingle_hashes(hashes, rows, n, len(items))
            order = np.lexsort((h, at))
            at, h = at[order], h[order]
            bounds = np.searchsorted(at, np.arange(len(items) + 1))
            for i in range(len(items)):
                if self.k[i] == n:
                    own = np.unique(h[bounds[i] : bounds[i + 1]])
                    groups.setdefault((n, 1 << (len(own).bit_length() - 1)), []).append((i, own))
        self.partitions = []
        for (n, least), members in sorted(groups.items()):
            largest = max(len(own) for _, own in members)
            length = largest - -(-percent * largest // 100) + 1
            sketch = [own[:length] for _, own in members]
            hashes_, owners = np.concatenate(sketch), np.repeat([i for i, _ in members], [len(s) for s in sketch])
            order = np.argsort(hashes_, kind="stable")
            self.partitions.append(Partition(n, least, hashes_[order], owners[order]))
        self.percent = percent
        self.seen = {}  # by k: which low 16 bits any sketch hash has
        for p in self.partitions:
            self.seen.setdefault(p.k, np.zeros(1 << 16, bool))[(p.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item number, shingles of the item, those that the row's text holds) of every contained item."""
        lowered = pc.utf8_lower(column)
        buf, offsets = text_offsets(lowered)
        start, end, rows = word_spans(buf, offsets, _WORD)
        hashes = word_hashes(buf, start, end)
        found: set[tuple[int, int]] = set()
        n_words = np.bincount(rows, minlength=len(column))
        for n, seen in self.seen.items():
            at, h = shingle_hashes(hashes, rows, n, len(column))
            maybe = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at, h = at[maybe], h[maybe]
            for p in self.partitions:
                if p.k != n:
                    continue
                a, b = np.searchsorted(p.hashes, h, "left"), np.searchsorted(p.hashes, h, "right")
                # a text of w words has at most w - k + 1 shingles
                for j in np.flatnonzero((b > a) & (100 * (n_words[at] - n + 1) >= self.percent * p.least)):
                    found.update((int(at[j]), int(i)) for i in p.owners[a[j] : b[j]])
        words: tuple[int, list[str]] = (-1, [])
        sets: dict[int, set] = {}
        for row, i in sorted(found):
            if words[0] != row:
                words, sets = (row, _words(lowered[row].as_py() or "")), {}
            n = self.k[i]
            if n not in sets:
                sets[n] = _shingles(words[1], n)
            common = len(self.shingles[i] & sets[n])
            if 100 * common >= self.percent * len(self.shingles[i]):
                yield row, i, len(self.shingles[i]), common


def _blocks(benchmark: DataFrame, k: int, percent: int) -> Iterator[Sketches]:
    """The benchmark in blocks of about ``BLOCK_BYTES``; rows with a null id or without text are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    n = -(-int(items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]) // BLOCK_BYTES)
    for b in range(n):
        rows: list[Row] = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield Sketches([(r.item_id, r.text) for r in rows], k, percent)


def find_contained(documents: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(item_id, doc_id, n_shingles, n_found, containment): every item of which a document holds at least ``percent`` %.

    What counts are the item's distinct shingles of ``k`` words (of all its words if it has fewer), words being lowered runs of letters
    and digits. Items without words match nothing. Null and empty texts hold nothing; repeated ids give a
    row for each pair of rows; either table may be empty; texts may be of any length, each is read whole within one batch; other columns are
    not read, whatever their names. No shuffle.
    """
    spark = documents.sparkSession
    schema = "item_id long, doc_id long, n_shingles long, n_found long, containment double"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, k, percent):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in split_batches(batches):
                ids = batch.column(0).to_pylist()
                rows = [(shared.value.ids[i], ids[row], n, m, m / n) for row, i, n, m in shared.value.search(batch.column(1))]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.float64()]
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["item_id", "doc_id", "n_shingles", "n_found", "containment"])

        found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(documents: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without the rows that :func:`find_contained` would report, all columns kept; one pass a block, no shuffle."""
    spark = documents.sparkSession
    at = documents.columns.index("text")
    for block in _blocks(benchmark, k, percent):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in split_batches(batches):
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in shared.value.search(batch.column(at)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
