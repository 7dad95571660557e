import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import jaccard
from quarry.llm.components import connected_components
from quarry.llm.jaccard import first_of_classes, jaccard_classes, link_block


def brute(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, b in enumerate(ids):
        for a in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(r.choices(vocabulary, k=12))
    bases = [r.choices(vocabulary, k=r.choice([1, 2, 3, 5, 8, 20, 60, 200, 600])) for _ in range(25)]
    rows = []
    for n in range(260):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 9])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        text = " ".join(words)
        rows.append((n * 3 + 1, text + " " + shared if r.random() < 0.3 else text.upper() if r.random() < 0.1 else text))
    return [*rows, (5000, None), (5001, ""), (5002, " \n\t"), (5003, "é"), (5004, "É"), (5005, "x y"), (5006, "X\ty")]


@pytest.mark.parametrize(("seed", "k", "percent", "short", "long", "block"), [(1, 4, 85, 32, 256, 512), (2, 5, 80, 3, 5, 7), (3, 4, 85, 2, 400, 30)])
def test_classes(spark, monkeypatch, seed, k, percent, short, long, block):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "LONG_LIST", long)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block * 100)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_link_block_equals_brute_force():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 5, 40, 200, 900)]
    sets = []
    for _ in range(300):
        s = base[rng.integers(len(base))]
        s = s[rng.random(len(s)) > rng.choice([0, 0.02, 0.1])]
        sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 60, rng.integers(0, 1 + len(s) // 10)).astype(np.uint64)])))
    got = {(i, int(j)) for i, found in link_block(sets, 85) for j in found}
    plain = [set(s.tolist()) for s in sets]
    want = {(i, j) for i in range(300) for j in range(300) if i != j and plain[i] and 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])}
    assert got == want
    left = np.arange(300) % 2 == 0
    assert {(i, int(j)) for i, found in link_block(sets, 85, left) for j in found} == {(i, j) for i, j in want if left[i] != left[j]}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7)] + [(200, x) for x in range(201, 240)] + [(None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {90: 90, 95: 90, 100: 90} | {x: 200 for x in range(200, 240)}


def test_components_of_leaves_between_two_centres(spark):
    """Rounds that end in a leaf of two centres, none of which is a leaf itself."""
    edges = [(9, 3), (12, 8), (2, 0), (1, 4), (4, 5), (2, 6), (0, 8), (8, 5)] + [(100 + a, 100 + b) for a, b in [(9, 0), (2, 7), (11, 9), (5, 13), (2, 3), (11, 6), (13, 9), (7, 5), (4, 1)]]
    got = sorted(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    first = {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 0, 6: 0, 8: 0, 9: 3, 12: 0}
    second = {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0, 9: 0, 11: 0, 13: 0}
    assert got == sorted([*first.items(), *((100 + a, 100 + b) for a, b in second.items())])


def test_large_component_of_several_classes(spark, monkeypatch):
    """A chain of near copies, a far group that the same frequent words tie to it, and a row repeated often."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 5)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = random.Random(4)
    common = [f"c{i}" for i in range(40)]
    own = [f"x{r.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(own[i : i + 200] + common)) for i in range(0, 200, 3)]  # neighbours link, the ends don't
    rows += [(1000 + i, " ".join(common + [f"y{i % 9}z{j}" for j in range(6)])) for i in range(60)]
    got = {i.doc_id: (i.n_shingles, i.component_id) for i in jaccard_classes(spark.createDataFrame(rows + rows[5:6] * 300, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_rows_that_share_ids(spark):
    r = random.Random(9)
    x, y, z = (" ".join(f"{c}{r.randrange(1000)}" for _ in range(90)) for c in "xyz")
    near = f"other {x}"
    rows = [(1, x), (1, y), (1, x), (2, near), (3, y), (2, z), (4, z), (5, "w" * 400_000), (None, x), (0, ""), (0, None), (6, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((i.doc_id, i.component_id) for i in jaccard_classes(df, 4, 85).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (2, 2), (3, 1), (4, 2), (5, 5), (6, 6)]
    kept = [(i.doc_id, i.text) for i in first_of_classes(df, 4, 85).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[1], rows[2], rows[5], rows[7], rows[8], rows[9], rows[10], rows[11]], key=str)


def test_order_sees_long_lists_however_many_documents(spark, monkeypatch):
    """The sample grows with the table once a fixed one would no longer show tokens whose lists are long."""
    monkeypatch.setattr(jaccard, "ORDER_SAMPLE", 20)
    monkeypatch.setattr(jaccard, "LONG_LIST", 40)
    rows = [(i, f"a b c d{i % 50}") for i in range(4000)]  # each shingle of 80 documents
    tokens, counts = jaccard.frequent_tokens(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert len(tokens) == 50 and counts.min() >= 3


def test_middle_lists_give_rows_in_proportion(monkeypatch):
    """Near copies in lists of which each pair shares one only: pairs are at most DENSE a member, others are tied."""
    r = random.Random(3)
    lists = [sorted(r.sample(range(400), 40)) for _ in range(60)]
    hub = pa.array([0] * len(lists), pa.int64())
    one = pa.array([[{"doc": d, "n": 150} for d in x] for x in lists], pa.list_(pa.struct([("doc", pa.int64()), ("n", pa.int32())])))
    monkeypatch.setattr(jaccard, "PAIR_ROWS", 50)
    got = pa.Table.from_batches(jaccard._middle_pairs([pa.record_batch([hub, one], ["hub", "one"])], 80)).to_pylist()
    assert len(got) <= jaccard.DENSE * 400
    up = list(range(400))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for g in got:
        up[root(g["b"])] = root(g["a"])
    assert all(root(x) == root(y[0]) for y in lists for x in y)
