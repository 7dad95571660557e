"""As-of match, containment, bounded similarity, memberships and typed JSON against plain Python."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.json import typed
from quarry.operators import build, duplicates, evaluate, releases, search
from quarry.operators.asof import last_before


@pytest.mark.parametrize("blocks", [1, 7, None])
def test_last_before(spark, blocks):
    r = random.Random(1)
    rows = [(i, r.choice(["hot"] * 8 + ["a", "b", None]), r.choice([None, *range(60)]), "x") for i in range(500)]
    marks = [(r.choice(["hot"] * 4 + ["a", None]), r.choice([None, *range(0, 60, 3)]), r.randrange(5)) for _ in range(60)]
    left = spark.createDataFrame(rows, "id int, k string, n int, row string").withColumns({"block": F.lit(1), "mark": F.lit(2)})  # clashing names
    out = last_before(left, spark.createDataFrame(marks, "k string, n int, v int"), "k", "n", ["v"], blocks)
    assert out.columns == ["id", "k", "n", "row", "block", "mark", "v"]

    def want(k, n):
        own = [(m, v) for key, m, v in marks if key is not None and key == k and m is not None and n is not None and m <= n]
        return max(own)[1] if own else None

    assert {x.id: x.v for x in out.collect()} == {i: want(k, n) for i, k, n, _ in rows}


def test_last_before_of_empty_tables(spark):
    left, marks = spark.createDataFrame([(1, "a", 1)], "id int, k string, n int"), spark.createDataFrame([("a", 1, 2)], "k string, n int, v int")
    assert [tuple(x) for x in last_before(left, marks.limit(0), "k", "n", ["v"]).collect()] == [(1, "a", 1, None)]
    assert last_before(left.limit(0), marks, "k", "n", ["v"]).collect() == []


def test_a_fingerprint_that_all_share_makes_no_join(spark):
    new = spark.range(1, 3001).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), F.col("id").alias("number"), F.lit("same").alias("fingerprint"))
    known = spark.range(0, 3000, 10).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("tag"), F.col("id").alias("number"), F.lit("same").alias("fingerprint"))
    out = releases.extend_cover(new, known)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {x.revision: (x.tag, x.distance) for x in out.collect()}
    assert got == {f"c{i}": (f"r{min(2990, i // 10 * 10)}", i - min(2990, i // 10 * 10)) for i in range(1, 3001)}


def test_targets_with_a_pair_that_every_row_has(spark):
    r = random.Random(2)
    rows = [{"lang": "en", "source": f"s{r.randrange(30)}", "id": str(i), **({"x": str(r.randrange(4))} if r.random() < 0.3 else {})} for i in range(2000)]
    targets = [{"lang": "en"}, {"lang": "de"}, {}, {"lang": "en", "source": "s3"}, {"lang": "en", "source": "s99"}, {"x": "1", "lang": "en", "source": "s5"}, {"id": "77", "lang": "en"}, {"id": "77", "source": "none"}, {"x": "0", "id": "3"}, {"lang": "en"}]
    corpus = spark.createDataFrame([(x,) for x in rows], "fields map<string,string>")
    found = evaluate.present(spark.createDataFrame([(t,) for t in targets] + [(None,)], "target map<string,string>"), corpus)
    want = [t for i, t in enumerate(targets) if t not in targets[:i] and (not t or any(t.items() <= x.items() for x in rows))]
    key = lambda t: sorted(t.items())
    assert sorted((x.target for x in found.collect()), key=key) == sorted(want, key=key)
    assert evaluate.present(spark.createDataFrame([({"a": "1"},)], "target map<string,string>"), corpus.limit(0)).collect() == []


def test_no_ratio_exceeds_its_bounds(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "x + y", "ä😀", "𝔸b", "$1", "\\", " "]
    pairs = [("".join(r.choice(words) for _ in range(r.randrange(12))), "".join(r.choice(words) for _ in range(r.randrange(12)))) for _ in range(300)] + [("", ""), ("a", ""), ("abc", "cba")]
    a, b = F.col("a"), F.col("b")
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", duplicates.ratio_bound(a, b).alias("m"), duplicates.length_bound(a, b).alias("n")).collect()
    for x in rows:
        exact = difflib.SequenceMatcher(None, x.a, x.b).ratio()
        shared = sum(min(x.a.count(c), x.b.count(c)) for c in set(x.a))
        assert exact <= x.m + 1e-9 and x.m <= x.n + 1e-9 and abs(x.m - (2 * shared / (len(x.a) + len(x.b)) if x.a or x.b else 1.0)) < 1e-9


def test_few_pairs_reach_python_and_none_is_lost(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice(["lemma", "group", "ring", "field", "order", "closed", "finite", "prime"]) + str(r.randrange(40)) for _ in range(r.randrange(8, 30))) for _ in range(40)]
    texts += [t.replace("1", "2", 1) for t in texts[:15]] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    pairs = docs.alias("p").join(docs.alias("q"), F.col("p.i") < F.col("q.i")).select(F.col("p.i").alias("x"), F.col("q.i").alias("y"), F.col("p.s").alias("s"), F.col("q.s").alias("t"))  # all pairs of a small group
    every = {(x.x, x.y): x.syntactic_similarity for x in duplicates.with_similarity(pairs, "s", "t").collect()}
    found = {(x.x, x.y): x.syntactic_similarity for x in duplicates.with_similarity(pairs, "s", "t", 0.9).collect()}
    assert found == {k: v for k, v in every.items() if v >= 0.9} and len(found) >= 20
    left = pairs.where(duplicates.length_bound(F.col("s"), F.col("t")) >= 0.9).where(duplicates.ratio_bound(F.col("s"), F.col("t")) >= 0.9).where("s <> t").count()
    assert left < len(every) / 4


def test_a_common_subsequence_bounds_the_ratio():
    from quarry.functions.arrow import common_subsequence, reaches, sequence_ratio

    assert common_subsequence("abcbdab", "bdcaba") == 4 and common_subsequence("", "x") == common_subsequence("x", "") == 0
    r = random.Random(2)
    for _ in range(300):
        a = "".join(r.choices("abcdé ", k=r.randrange(1, 300)))
        b = "".join(c for c in a if r.random() < 0.9) + "".join(r.choices("abc", k=r.randrange(9)))
        x = sequence_ratio(a, b)
        assert x <= 2 * common_subsequence(a, b) / (len(a) + len(b)) + 1e-12 and reaches(a, b, x)
    assert not reaches("".join(r.choices("abcdefgh", k=2000)), "".join(r.choices("abcdefgh", k=2000)), 0.85)


def test_a_large_group_of_copies_is_rows(spark):
    n = 20_000
    hits = spark.range(n).select(F.lit(1).alias("query_id"), F.col("id"), F.when(F.col("id") == 17, "").otherwise("E").alias("entry"), F.when(F.col("id") % 1000 == 999, F.concat(F.lit("k"), F.col("id").cast("string"))).otherwise("long key " * 20).alias("key"), F.col("id").alias("rank"))
    out = search.collapse_members(hits, 3)
    assert "key" not in out.columns
    rows = out.orderBy("place", "copy").collect()  # the scan ends before rank 2999, which opens the fourth group
    assert [(x.place, x.copy, x.id) for x in rows[:3]] == [(1, 0, 17), (1, 1, 0), (1, 2, 1)] and len(rows) == 2999
    assert [(x.place, x.id) for x in rows if x.place > 1] == [(2, 999), (3, 1999)]
    nested = search.collapse(hits, 3).orderBy("place").collect()
    assert [(x.place, x.id, len(x.copies)) for x in nested] == [(1, 17, 2996), (2, 999, 0), (3, 1999, 0)] and [c.id for c in nested[0].copies[:3]] == [0, 1, 2]


def test_unbuilt_sessions_are_rows(spark):
    sessions = spark.createDataFrame([("a", None), ("b", "broken"), ("c", None), ("d", None)], "session string, error string")
    done, lacking = spark.createDataFrame([("c",), ("d",), ("d",)], "session string"), spark.createDataFrame([("d",), ("a",)], "session string")
    members = build.unbuilt(sessions, done, lacking)
    assert sorted(tuple(x) for x in members.collect()) == [("a", "not built"), ("b", "broken"), ("d", "missing exports")]
    assert sorted(tuple(x) for x in build.unbuilt_counts(members).collect()) == [("broken", 1, "b"), ("missing exports", 1, "d"), ("not built", 1, "a")]


def test_typed_json(spark):
    texts = ['{"a": 1, "s": "x", "d": 1.5, "t": true, "o": {"b": [1, "y"]}, "n": null}', "[]", "no", None, '{"a": "1", "big": 12345678901}', '{"a": 1.5}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def got(path, kind, default=None):
        out = {x.i: tuple(x.x) for x in df.select("i", typed(F.col("t"), path, kind, default).alias("x")).collect()}
        return [out[i] for i in range(len(texts))]

    missing, broken = (None, "missing"), (None, "no JSON")
    assert got("$.a", "long") == [(1, None), missing, broken, missing, (None, "not a long"), (None, "not a long")]
    assert got("$.a", "long", F.lit(7)) == [(1, None), (7, None), broken, (7, None), (None, "not a long"), (None, "not a long")]
    assert got("$.a", "double")[0] == (1.0, None) and got("$.a", "double")[5] == (1.5, None) and got("$.big", "long")[4] == (12345678901, None)
    assert got("$.s", "string")[0] == ("x", None) and got("$.t", "boolean")[0] == (True, None) and got("$.n", "string")[0] == missing
    assert got("$.o.b[1]", "string")[0] == ("y", None) and got("$.o.b[0]", "string")[0] == (None, "not a string")
    assert json.loads(got("$.o", "object")[0][0]) == {"b": [1, "y"]} and json.loads(got("$.o.b", "array")[0][0]) == [1, "y"]
    with pytest.raises(ValueError, match="unknown kind"):
        typed(F.col("t"), "$", "date")
