"""Packages, answers, tools, calls, judging, reports, sessions and the live index."""

import io
import json
import os
import sys
import tarfile
import zlib

import pytest
import zstandard

from quarry.operators import build, duplicates, report, service, validate
from quarry.sources import interchange as I
from quarry.streaming.live import Live, Updates

from .test_interchange import fixture


def test_packages(tmp_path):
    (tmp_path / "g" / "data").mkdir(parents=True)
    (tmp_path / "g" / "manifest.json").write_text("{}")
    (tmp_path / "g" / "data" / "x.parquet").write_bytes(b"abc" * 1000)
    digest = service.package(str(tmp_path / "g"), str(tmp_path / "g.tar.zst"))
    assert digest == I.sha256_file(str(tmp_path / "g.tar.zst"))
    whole = (tmp_path / "g.tar.zst").read_bytes()
    calls = []

    def fetch(first, end):
        calls.append((first, end))
        if len(calls) == 2:
            raise OSError("cut off")
        return whole[first:end]

    target = str(tmp_path / "copy.tar.zst")
    with pytest.raises(OSError):
        service.download(fetch, len(whole), digest, target, 100)
    service.download(fetch, len(whole), digest, target, 100)
    assert calls[2][0] == 100 and open(target, "rb").read() == whole
    with pytest.raises(ValueError):
        service.download(lambda a, b: b"x" * (b - a), len(whole), digest, str(tmp_path / "bad"), 100)
    assert service.unpack(target, str(tmp_path / "out")) == ["data/x.parquet", "manifest.json"]
    assert (tmp_path / "out" / "data" / "x.parquet").read_bytes() == b"abc" * 1000
    assert service.resolve([str(tmp_path)], "copy") == target
    with pytest.raises(LookupError):
        service.resolve([str(tmp_path)], "g")
    with pytest.raises(LookupError):
        service.resolve([str(tmp_path)], "none")


@pytest.mark.parametrize("member", ["../x", "/x", "a/../../x", "a$b", "link"])
def test_unsafe_members(tmp_path, member):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as tar:
        info = tarfile.TarInfo(member)
        if member == "link":
            info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(info, io.BytesIO(b""))
    (tmp_path / "a.tar.zst").write_bytes(zstandard.compress(data.getvalue()))
    with pytest.raises(ValueError):
        service.unpack(str(tmp_path / "a.tar.zst"), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") and not os.path.exists(tmp_path / "out.tmp")


def test_answers():
    def fails(e):
        def run():
            raise e

        return run

    assert service.respond(lambda: {"b": 1, "a": "é"}) == (200, '{"a": "é", "b": 1}')
    for e, status in ((ValueError("bad"), 400), (service.NotAllowed("h"), 403), (service.NotFound("x"), 404), (service.Unavailable("n"), 503), (RuntimeError("secret"), 500)):
        got, text = service.respond(fails(e))
        assert got == status and "error" in json.loads(text) and "secret" not in text
    assert service.respond(lambda: 1, "POST")[0] == 405 and service.respond(lambda: 1, host_allowed=False)[0] == 403
    page = service.source_page("a<b", "x\ny & z\nw", 2, 2)
    assert "a&lt;b" in page and '<mark><span id="L2">    2  y &amp; z</span></mark>' in page and page.count("<mark>") == 1
    assert service.revision(" 0123456789ab+\n") == ("0123456789ab", True) and service.revision("0123456789ab") == ("0123456789ab", False)
    with pytest.raises(ValueError):
        service.revision("tip")


def test_tool_and_server(tmp_path):
    tool = service.Tool(lambda query, limit, entries=(): [{"id": i, "src": query * 5, "vector": 1} for i in range(limit)], ("id", "src"), 3, 4)
    assert tool({"query": "ab", "limit": 9}) == {"results": [{"id": i, "src": "abab"} for i in range(3)], "more": True}
    for bad in ({}, {"query": 1}, {"query": "x", "limit": True}, {"query": "x", "other": 1}):
        with pytest.raises(ValueError):
            tool(bad)
    mark = tmp_path / "up"
    code = f"import time; open({str(mark)!r}, 'w'); time.sleep(60)"
    with service.Managed([sys.executable, "-c", code], mark.exists) as server:
        assert server.process.poll() is None
    assert server.process.poll() is not None
    with pytest.raises(service.Unavailable), service.Managed([sys.executable, "-c", ""], lambda: False, 30):
        pass
    log = service.logged("quarry-test", str(tmp_path / "log"))
    log.info("one %d", 1)
    assert (tmp_path / "log").read_text().endswith("one 1\n")


def test_calls():
    seen, pauses = [], []

    def transport(*answers):
        left = list(answers)

        def run(url, headers, body):
            seen.append((url, headers, body))
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return run

    call = lambda *a: build.posted(transport(*a), "u", {}, "k", sleep=pauses.append)
    assert call((429, {}), OSError("x"), (200, {"y": 1})) == {"y": 1} and pauses == [2.0, 4.0]
    assert seen[0][1]["Authorization"] == "Bearer k"
    with pytest.raises(build.Refused):
        call((400, {}), (200, {}))
    with pytest.raises(OSError):
        call((500, {}), (503, {}), (429, {}))
    good = {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
    assert build.embedder(transport((200, good)), "http://h/", "m")(["a", "b"]) == [[1.0], [2.0]]
    assert build.embedder(transport((200, {"embeddings": [[3.0]]})), "http://h", "m", "ollama")(["a"]) == [[3.0]]
    for data in ([{"index": 0, "embedding": []}] * 2, [{"index": 0, "embedding": []}], [{"embedding": []}, {"index": 1, "embedding": []}], None):
        with pytest.raises(ValueError):
            build.embeddings_of({"data": data}, 2)
    with pytest.raises(ValueError):
        build.embedder(transport(), "u", "m", "other")
    chat = lambda why: (200, {"choices": [{"message": {"content": "t"}, "finish_reason": why}]})
    assert build.generator(transport(chat("length")), "u", "m")("p", 0.3) == build.Completion("t", True)
    assert build.generator(transport(chat("stop")), "u", "m")("p", 0.0) == build.Completion("t", False)
    assert seen[-1][2]["temperature"] == 0.0


def test_judge(spark):
    def model(prompt, temperature):
        if "fail" in prompt:
            raise OSError("no answer")
        return build.Completion("VERDICT: duplicate same" if "cut" not in prompt else "VERDICT: rel", "cut" in prompt)

    rows = [("a", 1, 0.1, "x", "y"), ("a", 2, 0.1, "x", "fail"), ("a", 3, 0.1, "x", "cut"), ("a", 4, 0.1, "x", "y"), ("b", 1, 0.5, "x", "y")]
    pairs = spark.createDataFrame(rows, "q string, rank int, distance double, src string, other_src string")
    got = {(r.q, r.rank): (r.verdict, r.justification, r.judge_truncated, r.judge_error is not None) for r in build.judge(pairs, "{first} {second}", model, 1).collect()}
    assert got == {("a", 1): ("DUPLICATE", "same", False, False), ("a", 2): (None, None, None, True), ("a", 3): (None, None, None, True), ("a", 4): (None, None, None, False), ("b", 1): (None, None, None, False)}
    assert build.has_verdict("x VERDICT: Related") == "sufficient" and build.has_verdict("VERDICT: rel") == "unusable"


def test_reports(spark, tmp_path):
    assert report.escape("a <b>\n & c.d [x]") == "a &lt;b&gt; &amp; c\\.d \\[x\\]"
    schema = "query_id string, query_src string, rank int, id string, src string, distance double, tier string, verdict string, justification string"
    rows = [("p", "P", 1, "x", "X", 0.1, "near-exact", None, None), ("p", "P", 2, "y", "Y", 0.2, "possible", "RELATED", "why"), ("q", "Q", 1, "z", "Z", 0.2, "possible", None, None), ("r", "R", 1, "w", "W", 0.9, None, None, None)]
    evidence = report.duplicate_evidence({"k": (spark.createDataFrame(rows, schema), {"aggregates": {"n": 3}})}, {"token": "kept"}, missing=("gone",))
    report.write_duplicates(str(tmp_path / "d"), evidence, "T")
    back = I.read_json(str(tmp_path / "d" / "duplicates.json"))
    assert [x["id"] for x in back["sections"]["k"]["items"]] == ["p", "q"] and back["thresholds"] == {"token": "kept"} and back["sections"]["k"]["aggregates"] == {"n": 3}
    near, every = ((tmp_path / "d" / f"{n}.md").read_text() for n in ("near-exact", "possible"))
    assert "### p (near\\-exact)" in near and "### q" not in near and "possible" not in near.split("### p")[1]
    assert "2 items, 3 pairs; near-exact: 1, likely: 0, possible: 1." in every and "RELATED: why" in every
    everything = report.duplicate_evidence({"k": (spark.createDataFrame(rows, schema), {})}, {}, everything=True)
    assert len(everything["sections"]["k"]["items"]) == 3
    results = [{"target": "t", "query_type": "k", "metric": m, "value": 1, "query": "q", "refined_query": "r", "top_results": [{"rank": 1}]} for m in ("rank", "reciprocal_rank")]
    report.write_benchmark(str(tmp_path / "b"), results, {"token": 1, "n": 2}, [{"query_type": "k", "metric": "rank", "average": 1.0, "sample_size": 1}], {"s": "why"})
    got = I.load_results(str(tmp_path / "b"))
    assert got["t"]["queries"]["k"] == {"metrics": {"rank": 1, "reciprocal_rank": 1}, "query": "q", "refined_query": "r", "top_results": [{"rank": 1}]}
    assert got["s"]["metadata"]["skipped_reason"] == "why" and got["summary"]["k"]["rank"]["sample_size"] == 1 and I.read_json(str(tmp_path / "b" / "manifest.json")) == {"n": 2}


def test_views_and_failures(spark):
    c = spark.createDataFrame([("p", "near-exact", "s" * 700), ("p", "possible", "t"), ("q", "possible", "u"), ("r", None, "v")], "query_id string, tier string, src string")
    assert {(r.query_id, r.best_tier, len(r.src)) for r in duplicates.reported(c, tiers=("possible",)).collect()} == {("p", "possible", 1), ("q", "possible", 1)}
    assert {(r.query_id, r.best_tier) for r in duplicates.reported(c, everything=True).collect()} == {("p", "near-exact"), ("q", "possible"), ("r", None)}
    selfs = spark.createDataFrame([(i, None if i % 2 else 1, 0.0) for i in range(60)], "query_id int, self_rank int, self_distance double")
    assert [r.query_id for r in duplicates.first_failures(selfs).collect()] == list(range(1, 41, 2))
    zipped = spark.createDataFrame([(["a", "b"], [[1.0], [2.0]])], "inputs array<string>, vectors array<array<double>>")
    assert [tuple(r) for r in validate.zipped(zipped).collect()] == [(0, "a", [1.0]), (1, "b", [2.0])]
    with pytest.raises(Exception, match="differ"):
        validate.zipped(spark.createDataFrame([(["a"], [[1.0], [2.0]])], "inputs array<string>, vectors array<array<double>>")).collect()


def test_session_sets_and_order(spark):
    s = spark.createDataFrame([("Main", None, "core"), ("A", "Main", "x"), ("B", "A", "x"), ("C", "B", "y"), ("D", "Main", "y")], "session string, parent string, group string")
    got = build.select_sessions(s, ["all-y"], [], "Main", {"all-y": s["group"] == "y"})
    assert sorted((r.session, r.depth) for r in got.collect()) == [("C", 3), ("D", 1)]
    assert [r.session for r in build.select_sessions(s, ["all"], ["B"], "Main").collect() if r.session in "BC"] == []
    chain = spark.range(1, 1500).selectExpr("'n' || id AS session", "'n' || (id - 1) AS parent", "'x' AS group")  # more ancestors than rows that a recursion may make
    assert [r.depth for r in build.select_sessions(chain, ["n1499", "n3"], ["n5"], "n0").collect()] == [3]
    assert [r.depth for r in build.select_sessions(chain, ["n1499"], [], "n0").collect()] == [1499]
    cycle = spark.createDataFrame([("A", "B", "x"), ("B", "A", "x")], "session string, parent string, group string")
    with pytest.raises(Exception):
        build.select_sessions(cycle, ["all"], [], "Main").collect()


def test_leases_formats_and_updates(spark, tmp_path):
    source, index = fixture(str(tmp_path / "in")), str(tmp_path / "index")
    manifest = json.load(open(os.path.join(source, "manifest.json")))
    json.dump(manifest | {"format": "another", "provenance": {"token": "kept"}}, open(os.path.join(source, "manifest.json"), "w"))
    with pytest.raises(ValueError):
        I.import_interchange(spark, source, index)
    first = I.import_interchange(spark, source, index, formats=("another",))
    live = Live(spark, index)
    with live.held("theorems") as corpus:
        second = I.import_interchange(spark, source, index, formats=("another",))
        assert I.prune(index) == [] and corpus.count() == 3
    if os.path.exists(first):
        assert I.prune(index) == [os.path.basename(first)]
    assert I.current(index) == second
    I.export_interchange(spark, second, str(tmp_path / "out"))
    assert I.read_json(str(tmp_path / "out" / "manifest.json"))["provenance"] == {"token": "kept"}
    assert sorted(os.listdir(tmp_path / "out" / "theorems")) == ["documents.jsonl", "vectors.f32"]
    now, state, fail, done = [0.0], ["a"], [True], []

    def update(x):
        if fail[0]:
            raise OSError("x")
        done.append(x)

    loop = Updates(lambda: state[0], update, 100, lambda: now[0])
    assert [loop.step(), loop.step()] == ["failed", "waiting"]
    now[0] = 101
    assert loop.step() == "failed"
    state[0], fail[0] = "b", False
    assert [loop.step(), loop.step()] == ["updated", "current"] and done == ["b"]


def test_records_keep_their_order_over_partitions(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "checksum": zlib.adler32(b"x"), "pad": "p" * (i % 97)}) for i in range(5000)]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = I.read_records(spark, str(tmp_path / "r.jsonl"))
        rows = sorted((r.ord, r.record, r.id) for r in df.select("ord", "record", "id").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(i, x, str(i)) for i, x in enumerate(lines)]
