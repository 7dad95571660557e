"""The pipeline against plain Python, stage by stage and as a whole."""

import hashlib
import random
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarry.llm.bpe import codec
from quarry.llm.quality import fit, score_documents

from .test_jaccard import brute as near
from .test_scans import _contained, _key


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(200)]
    items = [" ".join(r.choices(words, k=30)) for _ in range(5)]
    rows = []
    for i in range(240):
        text = " ".join(r.choices(words, k=r.choice([3, 20, 80])))
        if i % 6 == 5:
            text = " ".join(w + "###" for w in text.split())
        if i % 10 == 1:
            text = rows[i - 1][1].replace(words[0], words[1]) if i else text
        if i % 17 == 3:
            text += " " + r.choice(items)
        if i % 3 == 0:
            text = "Home page\n" + text
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
    rows += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "Home page", "en", None, 9)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 5), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(enumerate(items))


def _lines(docs):
    """Lines of ten or more different texts stay where they stand first."""
    holders, first = defaultdict(set), {}
    for _, t in sorted(docs.items()):
        for p, line in enumerate((t or "").split("\n")):
            holders[_key(line)].add(t or "")
            first.setdefault(_key(line), (t or "", p))
    stays = lambda t, p, k: not k or len(holders[k]) < 10 or first[k] == (t, p)
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if stays(t or "", p, _key(x))) for i, t in docs.items()}


def test_run_equals_plain_python(spark, folder):
    path, items = folder
    documents = spark.read.parquet(f"{path}/documents.parquet")
    scored = score_documents(documents, fit(documents, spark.read.parquet(f"{path}/labels.parquet"))).collect()
    docs = {x.doc_id: x.text for x in scored if x.score >= 0.3}
    junk = {x.doc_id for x in scored if x.text and x.text.count("###") > 0.9 * len(x.text.split())}
    assert len(junk) > 20 and len(junk & docs.keys()) <= 0.1 * len(junk) and len(docs) > 190
    docs = _lines(docs)
    assert len({t for t in docs.values() if "home page" in map(_key, t.split("\n"))}) == 1  # and its copies
    classes = near(list(docs.items()), 5, 80)
    docs = {i: t for i, t in docs.items() if classes[i][1] == i}
    docs = {i: t for i, t in docs.items() if not any((c := _contained(t, x)) and 100 * c[1] >= 80 * c[0] for x in items.values())}
    c = codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {i: (c.flat.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs.items()}
    got = {x.doc_id: (list(x.ids), x.decoded_sha256) for x in P.run(spark, path).collect()}
    assert got == want and 100 < len(got) < 220


def test_stages_keep_columns(spark, folder):
    path, _ = folder
    documents = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, documents, path)
        assert out.columns == documents.columns and out.dtypes == documents.dtypes, name
        assert stage(spark, documents.limit(0), path).count() == 0, name
    lines = P.line_dedup(spark, documents, path).collect()
    assert len(lines) == documents.count() and all(x.n_chars == len(x.text) for x in lines)


def test_copies_keep_one_text(spark):
    r = random.Random(4)
    line = lambda k: " ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(k))
    exact, near_by = "\n".join(line(8) for _ in range(6)), [line(8) for _ in range(20)]
    rows = [(i, f"Home page\n{line(30)}") for i in range(20)]
    rows += [(100 + i, f"Home page\n{exact}") for i in range(50)]
    rows += [(200 + i, "\n".join([*near_by, f"copy {i}"])) for i in range(50)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    lines = P.written(P.line_dedup(spark, docs, ""))
    assert {x.doc_id: x.text for x in lines.collect()} == _lines(dict(rows))
    got = {x.doc_id: x.text for x in P.ngram_jaccard_join(spark, lines, "").collect()}
    body = lambda i, t: t if i == 0 else t.removeprefix("Home page\n")
    assert got == {i: body(i, t) for i, t in rows if i <= 100 or i == 200} | {200 + i: f"copy {i}" for i in range(1, 50)}


CLASHES = ["score", "score_", "words", "n_lines", "n_dropped", "t", "t1", "t2", "pos", "line", "key", "row", "own", "of", "digest", "component_id", "item_id", "first", "node", "n"]


def test_any_columns_ids_and_texts(spark, folder):
    path, _ = folder
    documents = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 60")
    extra = [(None, "one two three four five six\nHome page"), (None, None), (7, "seven other words that nobody has"), (7, "seven other words that nobody has"), (7, ""), (8, "Home page"), (500, "long " * 200_000), (501, "x" * 300_000)]
    documents = documents.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in extra], documents.schema))
    for n, c in enumerate(CLASHES):
        documents = documents.withColumn(c, F.lit(n))
    documents = P.written(documents)
    rows = documents.collect()
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, documents, path)
        assert got.columns == documents.columns and got.dtypes == documents.dtypes, name
        got = got.collect()
        assert all([x[c] for c in CLASHES] == list(range(len(CLASHES))) for x in got), name
        own = lambda x: (x.doc_id, x.text)
        if name == "line dedup":
            assert len(got) == len(rows)
        else:
            assert not {own(x) for x in got} - {own(x) for x in rows}, name
    kept = [own(x) for x in P.ngram_jaccard_join(spark, documents, path).collect()]
    assert sorted(kept.count(x) for x in {(None, None), (7, ""), (None, extra[0][1])}) == [1, 1, 1] and kept.count(extra[2]) == 2
    out = P.bpe_encoding(spark, documents, path).collect()
    assert sorted(str(x.doc_id) for x in out) == sorted(str(x.doc_id) for x in rows)
