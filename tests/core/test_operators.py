import json
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions.constants import TIERS
from quarry.operators import build, duplicates, evaluate, releases, report, search, validate
from quarry.operators.search import SearchFilter
from quarry.operators.store import Store


def arc(spark, n=12):
    """Vectors on an arc, entries in turn."""
    rows = [(f"d{i:02}", [math.cos(0.1 * i), math.sin(0.1 * i)], ["", "E", "F", "", "E"][i % 5], f"S{i % 2}", f'lemma x{i}: "P{i % 4}"') for i in range(n)]
    return spark.createDataFrame(rows, "id string, vector array<float>, entry string, session string, src string")


@pytest.mark.parametrize(
    ("admit", "exclude", "want"),
    [
        (SearchFilter(), "", [0, 1, 2, 3, 4]),
        (SearchFilter("distribution"), "", [0, 3]),
        (SearchFilter("contributed"), "", [1, 2, 4]),
        (SearchFilter(entries=frozenset({"E"})), "", [0, 1, 3, 4]),
        (SearchFilter("contributed", frozenset({"E"})), "", [1, 4]),
        (SearchFilter("contributed", frozenset()), "", []),
        (SearchFilter(), "E", [0, 2, 3]),
    ],
)
def test_prefilter(spark, admit, exclude, want):
    got = arc(spark, 5).where(admit.prefilter(F.col("entry"), exclude)).orderBy("id").collect()
    assert [int(r.id[1:]) for r in got] == want


def test_filter_checks():
    f = SearchFilter("all", frozenset({"E", "F"}), frozenset({"S"}), ("countable", "⋃"))
    assert SearchFilter.of(f.parameters()) == f and SearchFilter.of({}) == SearchFilter()
    assert f.restrict(["E"], None).entries == {"E"} and SearchFilter().restrict(["E"], ["S"]).sessions == {"S"}
    for bad in ({"source": "distribution", "entries": "E"}, {"source": "nowhere"}):
        with pytest.raises(ValueError):
            SearchFilter.of(bad)
    for bad in (lambda: SearchFilter(entries=frozenset({""})), lambda: SearchFilter(mentions=("a b",)), lambda: search.check_request(" ", 5), lambda: search.check_request("x", 0), lambda: search.check_request("x", 1001)):
        with pytest.raises(ValueError):
            bad()


def test_postfilter(spark):
    f = SearchFilter("all", frozenset({"E", "F"}), frozenset({"S"}), ("countable", "⋃"))
    rows = [('lemma x: "countable (⋃ A)"', "S"), ('lemma x: "countable (⋃ A)"', "T"), ('lemma countable: "⋃ A"', "S")]
    df = spark.createDataFrame(rows, "src string, session string")
    assert [r.x for r in df.select(f.admits(F.col("session"), F.col("src")).alias("x")).collect()] == [True, False, False]


def test_search(spark):
    corpus = arc(spark)
    target = [math.cos(0.4), math.sin(0.4)]
    assert search.search(corpus, target, 1).first().id == "d04"
    # the post-filter sees the nearest candidates only
    got = search.search(corpus, target, 2, SearchFilter(sessions=frozenset({"S1"})), candidates=3)
    assert [r.id for r in got.collect()] == ["d03", "d05"]
    assert search.search(corpus, target, 5, SearchFilter(sessions=frozenset({"S1"})), candidates=5).count() == 2
    collapsed = search.search(corpus, target, 2, collapse_copies=True).orderBy("place").collect()
    assert [r.id for r in collapsed] == ["d04", "d03"] and collapsed[0].copies == []  # the third group ends the scan
    collapsed = search.search(corpus, target, 4, collapse_copies=True).orderBy("place").collect()
    assert collapsed[0].entry == "" and sorted([collapsed[0].id, *(c.id for c in collapsed[0].copies)]) == ["d00", "d04", "d08"]


def test_collapse(spark):
    rows = [(1, "a", "Zippy", "k"), (2, "b", "", "k"), (3, "c", "E", "m"), (4, "d", "F", "k"), (5, "e", "G", "n"), (6, "z", "H", "k")]
    hits = spark.createDataFrame([(0, *r) for r in rows], "query_id int, rank int, id string, entry string, key string")
    got = search.collapse(hits, 2).orderBy("place").collect()
    assert [r.id for r in got] == ["b", "c"] and [c.id for c in got[0].copies] == ["a", "d"] and got[1].copies == []
    assert [len(r.copies) for r in search.collapse(hits, 9).orderBy("place").collect()] == [3, 0, 0]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_knn_join(spark, monkeypatch, metric):
    monkeypatch.setattr(search, "QUERY_BYTES", 200)
    monkeypatch.setattr(search, "ROWS", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5)).astype(np.float32)
    v[50:] = v[:10]
    corpus = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "id long, vector array<float>, label int").repartition(3)
    queries = corpus.where("id % 7 = 0").select(F.col("id").alias("query_id"), "vector", F.col("label").alias("own"))
    got = search.knn_join(queries, corpus, 6, metric, exclude=("own", "label")).collect()
    d = v.astype(np.float64)
    for q in range(0, 60, 7):
        dist = ((d - d[q]) ** 2).sum(1) if metric == "l2" else np.maximum(0, 1 - d @ d[q] / np.sqrt((d * d).sum(1) * (d[q] @ d[q])))
        want = sorted((round(float(dist[i]), 9), i) for i in range(60) if i % 4 != q % 4)[:6]
        mine = sorted((r.rank, r.id, round(r.distance, 9)) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in want]
    assert search.knn_join(queries.limit(0), corpus, 3).count() == 0


def test_hits_kept_by_a_task():
    """Memory is numbers a query and hit, however many hits come: names may be texts, ties go by name."""
    rng = np.random.default_rng(1)
    best, every = search.Best(5, 3), []
    for _ in range(20):
        q = np.sort(rng.integers(0, 4, 50))
        d, names = rng.integers(0, 9, 50) / 8, [f"n{x}" for x in rng.permutation(1000)[:50]]
        best.take(q, d, pa.array(names))
        every += zip(q.tolist(), d.tolist(), names, strict=True)
    assert best.distance.nbytes == best.names.nbytes == 5 * 3 * 8
    got = [tuple(r.values()) for r in pa.Table.from_batches(best.rows(pa.array([0, 1, 2, 3, 4]))).to_pylist()]
    assert [(q, d, n) for q, n, d in got] == [x for q in range(5) for x in sorted(e for e in every if e[0] == q)[:3]]


def test_local_files(spark):
    hits = spark.createDataFrame([("R/a.x", "b", 2), ("R/../a.x", "b", 1), ("Q/a.x", "b", 1), ("R/z.x", "b", 1)], "file string, src string, start_line int")
    files = spark.createDataFrame([("R/a.x", "/r/a.x", "b\nb\nb")], "file string, local_file string, content string")
    assert [r.file for r in search.trusted_files(hits, ["R"], files).collect()] == ["R/a.x"]
    assert {r.file: r.local_line for r in search.with_local_lines(hits, files).collect()}["R/a.x"] == 2


def test_classify(spark):
    rows = [(0.01, 0.0, "DIFFERENT", "near-exact"), (0.5, 0.95, None, "near-exact"), (0.2, 0.1, "DUPLICATE", "likely"), (0.2, 0.1, None, "possible"), (0.4, 0.1, "DIFFERENT", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "d double, s double, v string, want string")
    for r in df.withColumn("t", duplicates.classify(F.col("d"), F.col("s"), F.col("v"))).collect():
        assert r.t == r.want
    best = df.withColumn("tier", F.col("want")).agg(duplicates.best_tier(F.col("tier")).alias("b"), duplicates.best_tier(F.when(F.lit(False), "x")).alias("n")).first()
    assert (best.b, best.n) == (TIERS[0], None)


def test_ground_truth(spark):
    src = 'lemma n: "a long enough statement of things"'
    rows = [("x", 0, "A", src, ["T.same"]), ("y", 1, "B", src + " ", ["U.same"]), ("z", 2, "A", src, ["V.same"]), ("w", 3, "C", "short", ["W.same"]), ("u", 4, "", src, ["X.same"])] + [(f"m{i}", 10 + i, f"E{i}", src, ["Y.many"]) for i in range(4)]
    docs = spark.createDataFrame(rows, "id string, ord int, entry string, src string, consts array<string>").withColumn("typs", F.array().cast("array<string>"))
    pairs, skipped = duplicates.ground_truth(docs, docs.where("id IN ('x', 'm0')").select("id"), group=4)
    assert {(r.id, r.other) for r in pairs.collect()} == {("x", "y"), ("y", "x")} | {p for i in (1, 2, 3) for p in (("m0", f"m{i}"), (f"m{i}", "m0"))}
    pairs, skipped = duplicates.ground_truth(docs, docs.where("id = 'm0'").select("id"), group=3)
    assert pairs.count() == 0 and skipped.first().skipped_groups == 2


def test_aggregates(spark):
    selfs = spark.createDataFrame([("a", 1, 0.0), ("b", 2, 0.1), ("c", None, None), ("d", 3, 0.01)], "query_id string, self_rank int, self_distance double")
    r = duplicates.self_retrieval(selfs).first()
    assert (r.documents, r.retrieved, r.failures, r.fraction, r.too_many) == (4, 3, 2, 0.5, True)
    assert duplicates.self_retrieval(selfs.limit(0)).first().fraction == 0
    h = duplicates.histogram(spark.createDataFrame([(1, 0.05), (1, 0.3), (1, 2.0), (2, 0.1)], "rank int, distance double")).collect()
    assert {x.bucket: x.n for x in h} == {"<= 0.05": 1, "<= 0.1": 0, "<= 0.2": 0, "<= 0.3": 1, "<= 0.5": 0, "<= 1.0": 0, "> 1.0": 1}


def test_metrics(spark):
    results = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, True), ("r", 1, False), ("r", 2, False)], "query_id string, rank int, relevant boolean")
    targets = spark.createDataFrame([("q", 1), ("r", 2), ("s", 0)], "query_id string, n_targets int")
    got = {r.query_id: r for r in evaluate.query_metrics(results, targets).collect()}
    assert got["q"].reciprocal_rank == 0.5 and got["q"].rank == 2 and got["q"].top_k_accuracy == 1
    assert abs(got["q"].normalized_discounted_cumulative_gain - (1 / math.log2(3) + 0.5)) < 1e-12  # more than 1
    assert (got["r"].rank, got["r"].reciprocal_rank, got["r"].top_k_accuracy) == (2, 0.0, 0) and got["s"].normalized_discounted_cumulative_gain == 0


def test_targets_and_texts(spark):
    corpus = spark.createDataFrame([({"a": "1", "b": "2"},), ({"a": "3"},)], "fields map<string,string>")
    targets = spark.createDataFrame([({"a": "1"},), ({"b": "2", "a": "1"},), ({"a": "1", "b": "9"},), ({"a": "1"},)], "target map<string,string>")
    assert sorted(sorted(r.target.items()) for r in evaluate.present(targets, corpus).collect()) == [[("a", "1")], [("a", "1"), ("b", "2")]]
    ok = corpus.select(evaluate.correct(F.col("fields"), F.array(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("z"), F.lit("1")))).alias("x")).collect()
    assert [r.x for r in ok] == [True, False]
    rows = spark.createDataFrame([("1", "t1", "n1"), ("2", "t2", "")], "id string, title string, natural string")
    saved = spark.createDataFrame([("1", "title", "saved text")], "id string, query_type string, query string")
    assert sorted((r.id, r.query_type, r.query, r.source) for r in evaluate.query_texts(rows, saved, ("title", "natural")).collect()) == [("1", "title", "saved text", "saved"), ("2", "title", "t2", "row")]
    data = json.dumps({"T": {"metadata": {}, "queries": {"title": {"query": "x"}}}, "S": {"metadata": {"skipped": True}}, "summary": {}}).encode()
    import hashlib

    assert evaluate.verified_saved_queries(data, hashlib.sha256(data).hexdigest()) == [("T", "title", "x")]
    with pytest.raises(ValueError):
        evaluate.verified_saved_queries(data, "0")


def test_validation(spark):
    records = spark.createDataFrame([("a", "s", "d", "e", 1), ("a", None, "d", "e", 2), ("", "s", "d", "e", 3)], "id string, src string, llm_description string, embedding_input string, checksum long")
    r = validate.record_faults(records).first()
    assert (r.n, r.empty_ids, r.missing_src, r.repeated_ids) == (3, 1, 1, 1)
    assert validate.checksum_faults(records).count() == 3
    ids = lambda xs: spark.createDataFrame([(x, "f", "") for x in xs], "id string, file string, entity_kname string")
    assert validate.guard_pruning(ids("abcd"), ids("ab")) == (2, 4)
    with pytest.raises(ValueError):
        validate.guard_pruning(ids("abcd"), ids("a"))
    assert validate.guard_pruning(ids("abcd"), ids("a"), allow=True) == (3, 4)
    assert [p for p in ("a/b.c", "/a", "a//b", "a/../b", "$x/a", "~/a", ".", "a/", "a") if validate.safe_path(p)] == ["a/b.c", "a"]
    good = {"kind": "k", "count": 1, "dimension": 2, "metric": "l2", "recipe": {"model": "m", "add_metadata": True, "prompts": {"embed": "{doc_src}"}}}
    validate.check_manifest({"format": "f", "version": 1, "corpora": [good]}, ("f",), 1)
    for bad in ({"format": "g", "version": 1, "corpora": [good]}, {"format": "f", "version": 1, "corpora": []}, {"format": "f", "version": 1, "corpora": [good, good]}, {"format": "f", "version": 1, "corpora": [good | {"metric": "x"}]}):
        with pytest.raises(ValueError):
            validate.check_manifest(bad, ("f",), 1)


def test_stores(spark, tmp_path):
    folder = str(tmp_path / "store")
    blocks = spark.createDataFrame([("a", "lemma a", "", ""), ("b", "lemma b", "", ""), ("c", "lemma FAIL", "", ""), ("d", "lemma a", "", "")], "id string, src string, title string, abstract string")

    def model(prompt, temperature):
        if "FAIL" in prompt:
            raise OSError("no")
        return build.Completion(f"x<BEGIN>said {prompt}<END>")

    described = build.describe(blocks.select(F.col("id").alias("key"), F.col("src").alias("prompt")), model, attempts=1)
    assert {r.key: r.status for r in described.collect()} == {"a": "ok", "b": "ok", "c": "failed", "d": "ok"}
    told = build.documents(blocks.where("id <> 'c'"), "{theorem_content}", "D: {doc_src}", str(tmp_path / "told"), model).collect()
    assert {r.id: r.embedding_input for r in told} == {"a": "D: said lemma a\n\nlemma a", "b": "D: said lemma b\n\nlemma b", "d": "D: said lemma a\n\nlemma a"}
    wanted = blocks.select(build.cache_key(F.lit("m"), F.col("src")).alias("key"), F.col("src").alias("text"), "id")
    embedded = build.through_store(wanted.where("id <> 'b'"), folder, lambda m: build.embed(m, build.hash_embedder(3)))
    assert {r.id for r in embedded.collect()} == {"a", "c", "d"} and Store(spark, folder).read().count() == 2
    asked = []
    again = build.through_store(wanted, folder, lambda m: (asked.append(m.count()), build.embed(m, build.hash_embedder(3)))[1])
    assert again.count() == 4 and asked == [1]


def test_completion_policy():
    calls = []

    def model(outcomes):
        def run(prompt, temperature):
            calls.append(temperature)
            x = outcomes.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return run

    quiet = {"sleep": lambda s: None}
    cut, good = build.Completion("part", True), build.Completion("whole")
    assert build.completed("p", model([cut, good]), lambda t: "unusable", **quiet) == good and calls == [0.0, 0.3]
    assert build.completed("p", model([cut, OSError(), OSError()]), lambda t: "fallback", **quiet) == cut
    assert build.completed("p", model([cut]), lambda t: "sufficient", **quiet) == cut
    with pytest.raises(build.Failure):
        build.completed("p", model([build.Completion(""), OSError("x"), cut]), lambda t: "unusable", **quiet)


def test_sessions(spark):
    s = spark.createDataFrame([("Main", None, "core"), ("A", "Main", "x"), ("B", "A", "x"), ("C", "Main", "y")], "session string, parent string, group string")
    names = lambda df: sorted(r.session for r in df.collect())
    assert names(build.select_sessions(s, ["all"], [], "Main")) == ["A", "B", "C"]
    assert names(build.select_sessions(s, ["x"], [], "Main")) == ["A", "B"]
    assert names(build.select_sessions(s, ["all"], ["A"], "Main")) == ["C"]
    with pytest.raises(ValueError):
        build.select_sessions(s, ["Z"], [], "Main")


def test_releases(spark):
    r = spark.createDataFrame([("v2026-1", False, False, "2026-01", "aaa"), ("v2026-2", False, False, "2026-02", "bbb"), ("v2026-3", True, False, "2026-03", "ccc"), ("odd", False, False, "2026-04", "ddd"), ("v2026-4", False, False, "2026-05", "eee")], "tag string, draft boolean, prerelease boolean, published string, revision string")
    a = spark.createDataFrame([("v2026-1", "SHA256SUMS", 1), ("v2026-1", "p", 5), ("v2026-2", "SHA256SUMS", 2), ("v2026-4", "p", 3), ("odd", "SHA256SUMS", 1)], "tag string, name string, size long")
    good = releases.usable(r, a)
    assert [(x.tag, x.size) for x in good.collect()] == [("v2026-2", 2), ("v2026-1", 6)]
    listed = spark.createDataFrame([("zzz", "v2026-1", 3), ("yyy", "gone", 1)], "revision string, tag string, distance int")
    cover = releases.covered(good, listed)
    assert sorted(tuple(x) for x in cover.collect()) == [("aaa", "v2026-1", 0), ("bbb", "v2026-2", 0), ("zzz", "v2026-1", 3)]
    assert [x.tag for x in releases.choose(cover, F.lit("zzzz")).collect()] == ["v2026-1"]
    new = spark.createDataFrame([("n1", 5, "f"), ("n2", 9, "f"), ("n3", 9, "g")], "id string, number int, fingerprint string")
    known = spark.createDataFrame([("v1", 3, "f"), ("v2", 7, "f")], "tag string, number int, fingerprint string")
    assert sorted(tuple(x) for x in releases.extend_cover(new, known).collect()) == [("n1", "v1", 2), ("n2", "v2", 2)]


def test_reports(spark, tmp_path):
    means = spark.createDataFrame([("All queries", "reciprocal_rank", 2, 0.5, 0.75, 0.25)], "query_type string, metric string, n long, previous double, current double, delta double")
    moves = spark.createDataFrame([("t", "k", 0.25)], "target string, query_type string, delta double")
    text = report.comparison(means, moves.limit(0), moves, moves.limit(0), moves, (spark.createDataFrame([("r", 1)], "reason string, n long"),) * 2)
    assert "| All queries | 2 | reciprocal_rank | 0.5000 | 0.7500 | +0.2500 |" in text and "Improvements: 1.\n- t / k: +0.2500" in text
    report.write_benchmark(str(tmp_path / "b"), [{"target": "t", "query_type": "k", "metric": "rank", "value": 1}], {"api_key": "x", "n": 1})
    assert json.load(open(tmp_path / "b" / "manifest.json")) == {"n": 1} and os.path.exists(tmp_path / "b" / "results.json")


def test_ground_truth_pairs_of_all_documents(spark, tmp_path):
    from quarry.plans.queries import ground_truth_pairs

    text = "one two three " + "four five six " * 10
    rows = [(1, text, "s1"), (2, text + "x", "s2"), (3, text, "s1"), (50, "other words here", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, ground_truth_pairs(spark, str(tmp_path)).collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]
