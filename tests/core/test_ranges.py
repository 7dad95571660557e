"""Task-side files: line ranges, the data source, chunk digests, parts and copies."""

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators.validate import is_safe_path, safe_path
from quarry.sources import interchange as I
from quarry.sources import ranges as R
from quarry.sources.shared import Files


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nbb\n\nccc", "\n\n\n", "ä😀\r\nb\r\n", "x" * 100 + "\ny\n" + "z" * 57])
@pytest.mark.parametrize("step", [1, 3, 7, 1000])
def test_lines_of_ranges(spark, tmp_path, monkeypatch, text, step):
    path = tmp_path / "lines"
    path.write_bytes(text.encode())
    size = len(text.encode())
    if step == 1 and size > 20:
        return
    plan = [R.Range(str(path), a, b, first, n, "", 0) for a, b, first, n in R.line_ranges(spark, str(path), size, step)]
    want = text.split("\n")[: -1 if text.endswith("\n") or not text else None]
    if step > 1:
        assert sum(r.count for r in plan) == len(want)
    else:
        assert sum(r.count for r in plan) >= len(want)
    reader = R.RecordReader({"plan": json.dumps([[r.records, r.start, r.end, r.first, r.count, "", 0] for r in plan])}, _schema("ord long, record string"))
    got = [x for part in reader.partitions() for b in reader.read(part) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert [x[1] for x in got] == [w.removesuffix("\r") for w in want] and [x[0] for x in got] == list(range(len(want)))


def _schema(text):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


def test_the_source_reads_what_its_schema_names(spark, tmp_path):
    rows = np.arange(30, dtype="<f4").reshape(10, 3)
    rows.tofile(tmp_path / "v")
    (tmp_path / "r").write_text("".join(f'{{"id": "{i}"}}\n' for i in range(10)))
    plan = [R.Range(str(tmp_path / "r"), a, b, first, n, str(tmp_path / "v"), first) for a, b, first, n in R.line_ranges(spark, str(tmp_path / "r"), os.path.getsize(tmp_path / "r"), 25)]
    assert len(plan) > 3
    got = {r.ord: (r.record, r.vector) for r in R.read_ranges(spark, plan, 3).collect()}
    assert got == {i: (f'{{"id": "{i}"}}', rows[i].tolist()) for i in range(10)}
    blind = [R.Range("nowhere", p.start, p.end, p.first, p.count, p.vectors, p.row) for p in plan]
    assert R.read_ranges(spark, blind, 3, ("vector", "ord")).count() == 10  # no record is opened
    blind = [R.Range(p.records, p.start, p.end, p.first, p.count, "nowhere", p.row) for p in plan]
    assert sorted(r.record for r in R.read_ranges(spark, blind, 3, ("record",)).collect())[0] == '{"id": "0"}'
    assert R.read_ranges(spark, [], 3).count() == 0
    assert [r.vector for r in I.read_vectors(spark, str(tmp_path / "v"), 3).orderBy("ord").collect()] == rows.tolist()
    assert [r.id for r in I.read_records(spark, str(tmp_path / "r"), "id string").orderBy("ord").collect()] == [str(i) for i in range(10)]
    with pytest.raises(Exception, match="too short"):
        R.read_ranges(spark, [R.Range("", 0, 0, 0, 9, str(tmp_path / "v"), 5)], 3, ("vector",)).collect()


def test_one_spoilt_chunk_among_many(spark, tmp_path):
    data = np.random.default_rng(0).bytes(100_000)
    for i in range(5):
        (tmp_path / f"f{i}").write_bytes(data[: 20_000 * i])
    files = Files(spark, str(tmp_path)).walk()
    pieces = lambda: R.digests(str(tmp_path), R.chunks(spark, files, 1000))
    before = pieces().collect()
    assert len(before) == 1 + 20 + 40 + 60 + 80 and all(r.sha256 == hashlib.sha256((tmp_path / r.file).read_bytes()[r.start : r.start + r.length]).hexdigest() for r in before)
    table = spark.createDataFrame(before)
    assert R.faults(table, pieces()).collect() == []
    with open(tmp_path / "f3", "r+b") as f:
        f.seek(33_333)
        f.write(bytes([data[33_333] ^ 1]))
    os.truncate(tmp_path / "f4", 78_500)
    os.unlink(tmp_path / "f1")
    found = {(r.file, r.chunk, r.fault) for r in R.faults(table, pieces()).collect()}
    assert found == {("f3", 33, "changed"), ("f4", 78, "missing"), ("f4", 79, "missing")} | {("f1", i, "missing") for i in range(20)}
    extra = R.faults(table.where("file <> 'f2'"), table)
    assert {r.fault for r in extra.collect()} == {"extra"} and extra.count() == 40
    assert R.root_of(table) == R.root_of(table.repartition(7)) != R.root_of(table.where("chunk > 0"))
    assert R.whole_digests(spark, str(tmp_path), ["f2"]) == {"f2": hashlib.sha256(data[:40_000]).hexdigest()}


def test_parts_have_prefix_sums_and_can_be_put_together(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'{{"n": {i}}}' * (i % 3 + 1), [float(i), -float(i)]) for i in range(200)], "ord long, record string, vector array<float>").repartition(5)
    base = str(tmp_path / "kind")
    os.makedirs(base)
    open(os.path.join(base, "part-orphan.jsonl"), "w").close()  # of an attempt that failed
    parts = R.write_parts(rows, base, 4)
    assert len(parts) > 1 and [p["at"] for p in parts] == [sum(q["count"] for q in parts[:i]) for i in range(len(parts))] and not os.path.exists(os.path.join(base, "part-orphan.jsonl"))
    assert all(os.path.getsize(os.path.join(base, p["name"] + ".f32")) == p["vector_bytes"] == 8 * p["count"] for p in parts)
    R.put_together(spark, base, parts, {"jsonl": "all.jsonl", "f32": "all.f32"})
    assert open(os.path.join(base, "all.jsonl")).read().splitlines() == [f'{{"n": {i}}}' * (i % 3 + 1) for i in range(200)]
    assert np.fromfile(os.path.join(base, "all.f32"), "<f4").reshape(-1, 2)[:, 0].tolist() == list(map(float, range(200))) and len(os.listdir(base)) == 2
    with pytest.raises(ValueError, match="mounted"):
        R.put_together(spark, "hdfs://host/x", parts, {})


def test_a_spoilt_part_or_part_table_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"i{i}", "theorem", f"src {i}", "said", f"said\n\nsrc {i}", "E", [1.0, float(i)]) for i in range(50)], "ord long, id string, kind string, src string, llm_description string, embedding_input string, entry string, vector array<float>")
    spec = {"dimension": 2, "metric": "cosine", "recipe": {"model": "m", "add_metadata": False, "prompts": {"embed": "x"}}}
    folder, index = str(tmp_path / "out"), str(tmp_path / "index")
    I.write_interchange({"theorem": rows}, {"theorem": spec}, folder, layout="parts")
    assert I.open_corpus(spark, I.import_interchange(spark, folder, index), "theorem").count() == 50
    part = next(n for n in os.listdir(os.path.join(folder, "theorem")) if n.endswith(".f32"))
    with open(os.path.join(folder, "theorem", part), "r+b") as f:
        f.write(b"\x01")
    with pytest.raises(ValueError, match="changed"):
        I.import_interchange(spark, folder, index)
    manifest = json.load(open(os.path.join(folder, "manifest.json")))
    manifest["corpora"][0]["root"] = "0"
    json.dump(manifest, open(os.path.join(folder, "manifest.json"), "w"))
    with pytest.raises(ValueError, match="part table"):
        I.import_interchange(spark, folder, index)
    assert I.current(index).startswith(index)


def test_copies_and_small_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / "a" / str(i)).mkdir(parents=True)
        (tmp_path / "a" / str(i) / "x").write_bytes(bytes([i]) * (i * 1000))
    files = Files(spark, str(tmp_path / "a"))
    assert R.copied(spark, str(tmp_path / "a"), str(tmp_path / "b"), files.walk()) == 3000
    assert Files(spark, str(tmp_path / "b")).walk() == files.walk() == [("0/x", 0), ("1/x", 1000), ("2/x", 2000)]
    assert files.create("new.json", "{}") and not files.create("new.json", "[]") and files.read("new.json") == "{}"
    files.swap("new.json", "[1]")
    assert files.read("new.json") == "[1]" and files.names() == ["0", "1", "2", "new.json"] and files.modified("gone") == 0.0


def test_safe_paths_by_one_pattern(spark):
    paths = ["a", "a/b", "/a", "a//b", "a/", "a/../b", "..", ".", "a/.", ".a", "a.b/..c", "a\\b", "~a", "a$b", "", "a\0b", "a b", "ä/ö", "a/..", "./a", "a\nb"]
    rows = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string").select("p", is_safe_path(F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in rows} == {p: safe_path(p) for p in paths} | {None: False}


def test_small_texts_by_tasks(spark, tmp_path):
    names = ["a.txt", "b c.txt", "d+e.txt", "f%20g.txt", "ä.txt", "x.toml"]
    rows = spark.createDataFrame([(n, f"line of {n}\nand\r\nmore") for n in names], "name string, text string")
    assert R.write_files(rows, str(tmp_path)) == 6 and sorted(os.listdir(tmp_path)) == sorted(names)
    got = {r.name: r.text for r in R.read_files(spark, str(tmp_path), ".txt").collect()}
    assert got == {n.removesuffix(".txt"): f"line of {n}\nand\r\nmore" for n in names[:-1]}


def test_slices_of_a_batch_are_small_and_whole(monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", 100)
    records = ["a" * n for n in (0, 10, 300, 40, 40, 40, 1, 0)] + [None]
    batch = pa.RecordBatch.from_pydict({"ord": pa.array(range(9)), "record": pa.array(records, pa.string()), "vector": pa.array([[1.0, 2.0]] * 9, pa.list_(pa.float32()))})
    found = list(R._slices(iter([batch.slice(0, 0), batch, batch.slice(3, 2)])))
    assert [i for b in found for i in b.column(0).to_pylist()] == [*range(9), 3, 4]
    size = lambda b: sum(len(x or "") for x in b.column(1).to_pylist()) + 8 * b.num_rows
    assert all(size(b) <= 100 or b.num_rows == 1 for b in found) and len(found) == 5


def test_parts_are_written_slice_by_slice(spark, tmp_path):
    """A batch's lines and floats aren't made all at once, so a worker's memory doesn't follow the batch."""
    rows = spark.range(200).selectExpr("id AS ord", "concat('é', repeat('x', cast(id AS int) * 40)) AS record", "array(cast(id AS float), 0.5f) AS vector")
    R.SLICE_BYTES, held = 1000, R.SLICE_BYTES
    try:
        parts = R.write_parts(rows, str(tmp_path / "p"), 3)
    finally:
        R.SLICE_BYTES = held
    lines = b"".join((tmp_path / "p" / f"{p['name']}.jsonl").read_bytes() for p in parts)
    floats = b"".join((tmp_path / "p" / f"{p['name']}.f32").read_bytes() for p in parts)
    assert lines.decode() == "".join(f"é{'x' * 40 * i}\n" for i in range(200)) and np.frombuffer(floats, "<f4").tolist() == [x for i in range(200) for x in (i, 0.5)]
