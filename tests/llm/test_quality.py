"""The classifier's score against plain Python, feature by feature, and training in parts."""

import mmap

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import quality as Q
from quarry.llm.common import _BASE

M = (1 << 64) - 1
SPACES = " \t\n\x0b\x0c\r"


def mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & M
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & M
    return h ^ (h >> 31)


def word_hash(word):
    """The polynomial of the bytes' values, and the length."""
    total = sum(mix((b + 1) * 0x9E3779B97F4A7C15 & M) * pow(_BASE, i, 1 << 64) for i, b in enumerate(word.encode()))
    return mix((total + len(word.encode()) * 0x9E3779B97F4A7C15) & M)


def words_of(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def features(text):
    """Buckets of each of the four kinds."""
    hashes = [word_hash(w) for w in words_of(text)]
    top = lambda h: h >> (64 - Q.BITS)
    grams = []
    for k in (3, 4):
        own = []
        marked = " " + "".join(" " if c in SPACES else c for c in text) + " "
        for i in range(len(marked) - k + 1):
            piece = marked[i : i + k]
            if " " not in piece[1:-1]:
                value = ord(piece[0])
                for c in piece[1:]:
                    value = (value * 0x01000193 + ord(c)) & 0xFFFFFFFF
                value ^= value >> 15
                own.append((value * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - Q.BITS))
        grams.append(own)
    return [[top(h) for h in hashes], [top(mix((b - a) & M)) for a, b in zip(hashes, hashes[1:], strict=False)], *grams]


TEXTS = ["the quick brown fox", "", None, "a", "ab", "été  naïve\n\nword word word", "x" * 3000 + " y", "😀 ok.", " \t\n", "one\rtwo"]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[::-1], ["", None], ["a"], ["", "abc", ""]])
def test_score_is_the_mean_of_each_kinds_values(texts):
    r = np.random.default_rng(2)
    value, bias = r.standard_normal((Q.KINDS, Q.BUCKETS)), 0.3
    got = Q.score((value, bias), pa.array(texts, pa.string()))
    for text, g in zip(texts, got, strict=True):
        total = bias + sum(np.mean([value[k][b] for b in own]) for k, own in enumerate(features(text or "")) if own)
        assert abs(g - 1 / (1 + np.exp(-total))) < 1e-9, text


def test_no_labelled_text_is_left_out_by_its_length(spark):
    rows = [(i, ("good clear words about things " if i % 2 else "zzz qqq xxx spam spam ") * (1 + (i % 7) * 40)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    seen = []
    parts = Q.train_parts

    def counted(loads, n, seed=1):
        seen.append((len(loads), n, sum(len(x()) for x in loads)))
        return parts(loads, n, seed)

    Q.train_parts = counted
    try:
        for held in (Q.HELD_FEATURES, 2500):
            model = Q.fit(docs, labels, held=held)
            scores = model.score(pa.array([t for _, t in rows[:2]]))
            assert scores[0] < 0.3 < 0.7 < scores[1]
    finally:
        Q.train_parts = parts
    assert seen[0][0] == 1 < seen[1][0] and len({(n, m) for _, n, m in seen}) == 1 and seen[0][1] == seen[0][2]


def test_tables_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert Q.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).bias.tolist() == model.bias.tolist() == [0.0, 0.0]


def test_the_driver_maps_the_features_of_its_sample(spark):
    """They come by partitions and lie in a file, so they neither fill the driver's heap at once nor stay in its Python's memory."""
    texts = {i: f"word{i} other{i % 5} things é" * (1 + i % 3) for i in range(1, 60)}
    docs = spark.createDataFrame([*texts.items(), (7, None)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    parts, seen = Q.train_parts, []

    def looked_at(loads, n, seed=1):
        seen.extend(loads[0]())
        return parts(loads, n, seed)

    Q.train_parts = looked_at
    try:
        Q.fit(docs, labels)
    finally:
        Q.train_parts = parts

    def mapped(a):
        while a is not None and not isinstance(a, (np.memmap, mmap.mmap)):
            a = a.base
        return a is not None

    learned = [r.doc_id for r in docs.where(~Q.held_out()).orderBy("doc_id").collect()]
    assert [y for y, _, _ in seen] == [i % 2 for i in learned]
    assert all(mapped(f) and mapped(w) and f.dtype == np.int32 and w.dtype == np.float32 for _, f, w in seen)
    whole = [s for s, i in zip(seen, learned, strict=True) if i != 7]
    for (_, f, w), i in zip(whole, [i for i in learned if i != 7], strict=True):
        want = list(Q._counted(pa.record_batch([pa.array([texts[i]])], ["text"]), 0))[0]
        assert f.tolist() == want[0].tolist() and w.tolist() == want[1].tolist()
