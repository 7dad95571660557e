"""A supervised quality classifier over hashed word and character n-grams.

Every feature has a learned vector; a document is the sum, over the kinds of features, of the mean vector of the kind's
features in it; a softmax layer turns that into class probabilities. Kinds: words, differences of neighbouring
words (a pair's hash; equal neighbours all have the same one), and the three and four characters long pieces of words, a
word being taken with a mark before and behind it. Characters are code points, so no piece splits one.
Training is stochastic gradient descent in numpy on the driver, over a sample of labelled documents of bounded
size, whose features lie in a temporary file; scoring needs one number a feature, so it is table look-ups and sums.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SPACE, mix, split_batches, text_offsets, word_hashes, word_spans, written

#: Hash buckets of each kind of feature.
BITS = 18
BUCKETS = 1 << BITS
KINDS = 4
#: Labelled documents that the classifier learns from, at most; they are drawn by the hash of their id.
SAMPLE = 4000
#: Distinct features that the driver has at a time in a temporary file, of 8 bytes each; where the sample has more, each pass reads it in several parts.
HELD_FEATURES = 16 << 20
#: Bytes of text scored at once; a longer single text is taken alone.
SCORE_BYTES = 1 << 18
#: Length of a feature's vector; passes over the sample; first learning rate, which falls to 0 in equal steps.
DIMENSION, EPOCHS, RATE = 8, 12, 0.7
#: The sum of squared weights that a text counts with at least, when a step is measured by it.
LEAST_SPREAD = 0.05


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind, (buckets of its features in the order of the text, first, last): a row has those from first to last of it."""
    buf, offsets = text_offsets(column)
    n = len(offsets) - 1
    start, end, rows = word_spans(buf, offsets)
    words = word_hashes(buf, start, end, lower=False)
    of = np.searchsorted(rows, np.arange(n + 1))
    yield (words >> np.uint64(64 - BITS)).astype(np.int32), of[:-1], of[1:]
    pairs = mix(words[1:] - words[:-1]) >> np.uint64(64 - BITS)
    yield pairs.astype(np.int32), of[:-1], np.maximum(of[1:] - 1, of[:-1])
    texts = ["" if x is None else x for x in column.to_pylist()]
    # a mark before each text and after the last; white space is the mark within
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1)
    starts = np.append(0, ends[:-1])  # of the mark before each text; that behind it stands at its end
    space = (points < 33) & SPACE[np.minimum(points, 255)]
    points = np.where(space, np.uint32(32), points)
    for k in (3, 4):
        m = max(0, len(points) - k + 1)
        inside = space[1 : m + 1].copy()
        for j in range(2, k - 1):
            inside |= space[j : m + j]
        at = np.flatnonzero(~inside)
        value = points[at]
        for j in range(1, k):
            value = value * np.uint32(0x01000193) + points[at + j]
        value ^= value >> np.uint32(15)
        bucket = ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
        yield bucket, np.searchsorted(at, starts), np.searchsorted(at, np.maximum(ends + 2 - k, starts))


def _counted(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, weights) of each row: its distinct features over all kinds and their shares within the kind."""
    kinds = list(_features(batch.column(column)))
    for i in range(batch.num_rows):
        features, weights = [], []
        for k, (bucket, first, last) in enumerate(kinds):
            if last[i] > first[i]:
                u, c = np.unique(bucket[first[i] : last[i]], return_counts=True)
                features.append(u + k * BUCKETS)
                weights.append(c / (last[i] - first[i]))
        yield (np.concatenate(features).astype(np.int32), np.concatenate(weights).astype(np.float32)) if features else (np.zeros(0, np.int32), np.zeros(0, np.float32))


@dataclass
class Classifier:
    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def values(self) -> tuple[np.ndarray, float]:
        """All that scoring needs: for each kind, what each bucket adds to the logit of label 1, and what the bias does."""
        direction = self.out[:, 1] - self.out[:, 0]
        return (self.vectors @ direction).astype(np.float64).reshape(KINDS, BUCKETS), float(self.bias[1] - self.bias[0])

    def score(self, column: pa.Array) -> np.ndarray:
        return score(self.values(), column)


def score(values: tuple[np.ndarray, float], column: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text; a text without features has that of the bias alone."""
    value, bias = values
    total = np.full(len(column), bias)
    for k, (bucket, first, last) in enumerate(_features(column)):
        sums = np.concatenate(([0.0], np.cumsum(value[k][bucket])))
        # rows without features at the end of the text begin beyond the last one
        total += (sums[np.minimum(last, len(bucket))] - sums[np.minimum(first, len(bucket))]) / np.maximum(last - first, 1)
    return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> Classifier:
    """Learn from (label, features, weights). Without samples every score is a half."""
    return train_parts([lambda: samples], len(samples), seed)


def train_parts(parts: list[Callable[[], list[tuple[int, np.ndarray, np.ndarray]]]], n: int, seed: int = 1) -> Classifier:
    """:func:`train` on ``n`` samples of which one part is held at a time; parts come in a new order in each pass, and so do the samples of each."""
    rng = np.random.default_rng(seed)
    # features that are never met stay at nothing, so what chance put there doesn't score a text
    vectors = np.zeros((KINDS * BUCKETS, DIMENSION), np.float32)
    out = rng.uniform(-0.5, 0.5, (DIMENSION, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = max(1, EPOCHS * n), 0
    samples = parts[0]() if len(parts) == 1 else []
    for _ in range(EPOCHS):
        for part in rng.permutation(len(parts)) if len(parts) > 1 else (0,):
            if len(parts) > 1:
                samples = parts[part]()
            for i in rng.permutation(len(samples)):
                label, features, weights = samples[i]
                rate = RATE * (1 - step / steps)
                step += 1
                hidden = weights @ vectors[features]
                logits = hidden @ out + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[label] -= 1
                back = out @ p
                # steps are measured by what they change of this text's sums, so that they neither vanish in long texts nor overshoot in short ones
                out -= rate * np.outer(hidden, p) / max(1.0, float(hidden @ hidden))
                bias -= rate * 0.1 * p
                vectors[features] -= (rate / max(float(weights @ weights), LEAST_SPREAD) * weights)[:, None] * back
    return Classifier(vectors, out, bias)


def _held(rows: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``rows(doc_id, label, n, features, weights)`` as :func:`train` takes them, in order of id and label.

    Rows come a partition at a time and go on to a temporary file, of which the arrays are maps: it is read as training needs it and takes
    no memory that the system can't have back.
    """
    found: list[tuple[int, int, int, int]] = []  # id, label, place in the file, features
    with tempfile.TemporaryFile(prefix="features-") as f:
        at = 0
        for doc_id, label, n, features, weights in rows.select("doc_id", "label", "n", "features", "weights").toLocalIterator():
            f.write(features)
            f.write(weights)
            found.append((doc_id, label, at, n))
            at += 8 * n
        f.flush()
        data = np.asarray(np.memmap(f, np.uint8, "r", shape=(at,)) if at else np.zeros(0, np.uint8))  # the map outlives the file's name
    found.sort(key=lambda x: x[:2])
    return [(label, data[at : at + 4 * n].view(np.int32), data[at + 4 * n : at + 8 * n].view(np.float32)) for _, label, at, n in found]


def held_out(doc_id="doc_id"):
    """Documents never learned from: crc32 of the id in decimal, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = HELD_FEATURES) -> Classifier:
    """Learn ``labels(doc_id, quality)`` from at most ``sample`` documents that aren't held out, whatever their length: the driver
    has ``held`` features at a time in a temporary file, or those of one id.

    Labels that are null or other than 0 and 1 are left out; so are labels without a document. Where an id has both labels, 1
    counts. Rows that share an id are all learned from. Null and empty texts have no features; very long ones are read whole, in parts.
    Without labelled documents, as with an empty table, every score is 0.5. Other columns are not read.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    drawn = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, limit=SCORE_BYTES):
            found = list(_counted(batch, 1))
            size = pa.array([len(f) for f, _ in found], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(2), size, *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))], ["doc_id", "label", "n", "features", "weights"])

    table = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, n long, features binary, weights binary")
    table = written(table)
    sizes = table.groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most ``sample`` rows
    parts: list[list[int]] = [[]]
    total = 0
    for doc_id, n in sizes:
        if parts[-1] and total + n > held:
            parts.append([])
            total = 0
        parts[-1].append(doc_id)
        total += n

    def load(ids: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return _held(table if len(parts) == 1 else table.where(F.col("doc_id").isin(ids)))

    return train_parts([partial(load, ids) for ids in parts], table.count())


def score_documents(documents: DataFrame, model: Classifier, column: str = "score") -> DataFrame:
    """Every row of ``documents`` with ``column``: the probability that its whole text is of good quality.

    Only ``text`` enters the score. Null and empty texts are scored by the bias. Other columns, whatever their names (one
    named ``column`` is replaced), and repeated or null ids are carried along; the table may be empty. A text may be as long as
    a row can be: it is scored whole.
    """
    documents = documents.drop(column)
    shared = documents.sparkSession.sparkContext.broadcast(model.values())  # KINDS * BUCKETS doubles: 8 MB
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, "text", SCORE_BYTES):
            yield pa.record_batch([*batch.columns, pa.array(score(shared.value, batch.column(at)))], [*batch.schema.names, column])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField(column, DoubleType())]))
