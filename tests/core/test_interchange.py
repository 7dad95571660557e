import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.sources import interchange as I
from quarry.streaming.live import Live, Refreshed, incremental

VECTORS = [[1.0, 0.0, 0.0], [0.99, 0.01, 0.0], [0.0, 1.0, 0.0]]


def fixture(folder, spoil=None):
    corpora = []
    for kind in ("theorems", "definitions"):
        base = os.path.join(folder, kind)
        os.makedirs(base)
        with open(os.path.join(base, "documents.jsonl"), "w", encoding="utf-8") as f:
            for i, entry in enumerate("ABC"):
                src = f'lemma x{i}: "a + b = b + a"'
                said = f"Commutativity ∀α 😀 {kind} {i}"
                record = {"id": f"L/thys/{entry}/T|{kind}{i}", "src": src, "entry": entry, "kind": kind, "checksum": zlib.adler32(src.encode()), "llm_description": said, "embedding_input": f"{said}\n\n{src}", "start_line": i + 1, "consts": ["T.shared"], "extra": {"x": i}}
                if spoil == "checksum" and i == 1:
                    record["checksum"] += 1
                if spoil == "id" and i == 1:
                    record["id"] = f"L/thys/A/T|{kind}0"
                f.write(json.dumps(record, ensure_ascii=False) + "\n")
        rows = np.array(VECTORS, "<f4")
        if spoil == "zero":
            rows[1] = 0
        rows.tofile(os.path.join(base, "vectors.f32"))
        if spoil == "trailing":
            with open(os.path.join(base, "vectors.f32"), "ab") as f:
                f.write(b"x")
        files = {n: I.sha256_file(os.path.join(base, n)) for n in ("documents.jsonl", "vectors.f32")}
        if spoil == "digest":
            files["vectors.f32"] = "0" * 64
        corpora.append({"kind": kind, "count": 4 if spoil == "count" else 3, "dimension": 3, "metric": "cosine", "files": files, "recipe": {"model": "m", "add_metadata": False, "prompts": {"embed": "{doc_src}"}}})
    with open(os.path.join(folder, "manifest.json"), "w") as f:
        json.dump({"format": I.FORMAT, "version": I.VERSION, "corpora": corpora}, f)
    return folder


def test_round_trip(spark, tmp_path):
    source, index = fixture(str(tmp_path / "in")), str(tmp_path / "index")
    path = I.import_index(spark, source, index)
    assert I.current(index) == path
    corpus = I.open_corpus(spark, path, "theorems")
    assert corpus.count() == 3 and I.point(corpus, "L/thys/B/T|theorems1").first().start_line == 2
    near = search.nearest(corpus.select("id", "vector"), VECTORS[0], 3).collect()
    assert [r.id[-1] for r in near] == ["0", "1", "2"] and near[0].distance < 1e-6 and near[2].distance == 1
    I.export_interchange(spark, path, str(tmp_path / "out"))
    for kind in ("theorems", "definitions"):
        for name in ("documents.jsonl", "vectors.f32"):
            assert open(tmp_path / "out" / kind / name, "rb").read() == open(os.path.join(source, kind, name), "rb").read()
    again = I.import_index(spark, str(tmp_path / "out"), index)
    assert I.current(index) == again != path and I.prune(index) == [os.path.basename(path)]
    I.export_generation(spark, again, str(tmp_path / "shipped"))
    with pytest.raises(FileExistsError):
        I.export_generation(spark, again, str(tmp_path / "shipped"))
    installed = I.import_index(spark, str(tmp_path / "shipped"), str(tmp_path / "other"))
    assert I.open_corpus(spark, installed, "definitions").count() == 3
    part = next(os.path.join(d, n) for d, _, names in os.walk(tmp_path / "shipped" / "data") for n in names if n.endswith(".parquet"))
    with open(part, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        I.install_generation(spark, str(tmp_path / "shipped"), str(tmp_path / "other"))
    assert I.current(str(tmp_path / "other")) == installed


@pytest.mark.parametrize("spoil", ["checksum", "id", "zero", "trailing", "digest", "count"])
def test_faults_leave_the_index(spark, tmp_path, spoil):
    index = str(tmp_path / "index")
    with pytest.raises(ValueError):
        I.import_interchange(spark, fixture(str(tmp_path / "in"), spoil), index)
    assert os.listdir(index) == []


def test_small_sources(spark, tmp_path):
    (tmp_path / "b.csv").write_text('ID,query\n1,"two\nlines ""x"""\n\n2,y\n')
    rows = I.read_benchmark_csv(spark, str(tmp_path / "b.csv")).collect()
    assert [(r.ID, r.query) for r in rows] == [("1", 'two\nlines "x"'), ("2", "y")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "E.toml").write_text('title = "T"\ndate = 2020-01-02\n')
    assert [tuple(r) for r in I.read_metadata(spark, str(tmp_path / "m")).collect()] == [("E", "T", "", "2020-01-02")]
    (tmp_path / "m" / "embed.txt").write_text("a")
    (tmp_path / "m" / "embed_definitions.txt").write_text("b")
    prompts = I.read_prompts(str(tmp_path / "m"))
    assert [I.prompt_of(prompts, "embed", k) for k in ("theorems", "definitions")] == ["a", "b"]
    (tmp_path / "results.json").write_text("{}")
    assert I.load_results(str(tmp_path)) == {} == I.load_results(str(tmp_path / "results.json"))


def test_live_and_streams(spark, tmp_path):
    index = str(tmp_path / "index")
    first = I.import_interchange(spark, fixture(str(tmp_path / "in")), index)
    live = Live(spark, index)
    assert live.corpus("theorems").count() == 3
    I.write_json(os.path.join(index, "current.json"), {"generation": "generation-broken"})
    assert live.corpus("theorems").count() == 3 and live.good == first
    now, calls = [0.0], []
    value = Refreshed(lambda: calls.append(1) or len(calls), 10, lambda: now[0])
    assert [value.get(), value.get()] == [1, 1]
    now[0] = 11
    assert value.get() == 2
    blocks = str(tmp_path / "blocks")
    spark.createDataFrame([("a",), ("b",)], "id string").write.parquet(blocks)
    out = str(tmp_path / "seen")
    stream = lambda: incremental(spark.readStream.schema("id string").parquet(blocks), str(tmp_path / "check"), lambda df, n: df.write.mode("append").parquet(out)).awaitTermination(60)
    stream()
    spark.createDataFrame([("c",)], "id string").write.mode("append").parquet(blocks)
    stream()
    assert sorted(r.id for r in spark.read.parquet(out).select(F.col("id")).collect()) == ["a", "b", "c"]
