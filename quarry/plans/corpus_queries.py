"""Queries of what surrounds a search: interchange, stores, sessions, releases, reports, prompts and files, each beside SQL that says the same.

Tables of the driver stand in for the corpus; what writes does so in a new folder below the shared one and reads it back.
"""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.arrow import bytes_of_floats, canonical_json, floats_of_bytes
from ..operators import build, duplicates, evaluate, releases, report, search, validate
from ..operators.search import SearchFilter
from ..sources import interchange, ranges
from ..sources.shared import Files, shared_folder
from ..streaming.live import Live
from .catalog import ORACLES, query
from .queries import _NEAR, _ORDER, _STOP, _TIERED, _V, _corpus, _near, _queries, _r6, _table, _tiered, _vector


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one, made; its path where machines mount it, else its URI."""
    at = shared_folder(spark)
    Files(spark, at).make()
    return ranges.local_path(at) or at


# --- interchange ----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_V}, d AS (SELECT id, e, CASE label % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS kind, coalesce(text, 'v' || id) AS src, entry FROM v LEFT JOIN documents ON id = doc_id)
SELECT 'd' || id AS id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) - 1 AS ord, sha256(src) AS src, entry, round(e[1], 6) AS first, len(e) AS dimension FROM d"""
)
def interchange_round_trip(spark, sf_dir):
    """Written, imported, exported, imported again, shipped and installed; then read from the live generation."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = _corpus(spark, sf_dir).join(docs, "id", "left").withColumn("src", F.coalesce("text", F.concat(F.lit("v"), F.col("id").cast("string"))))
    kinds, specs = {}, {}
    for n, kind in enumerate(("even", "odd")):
        own = rows.where(F.col("label") % 2 == n)
        kinds[kind] = own.select(F.col("id").alias("ord"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("kind"), "src", "entry", F.lit("said").alias("llm_description"), F.concat(F.lit("said\n\n"), F.col("src")).alias("embedding_input"), "vector")
        specs[kind] = {"dimension": 64, "metric": "cosine", "recipe": {"model": "m", "add_metadata": False, "prompts": {"embed": "{doc_src}"}}}
    base = _folder(spark)
    at = lambda name: os.path.join(base, name)
    interchange.write_interchange(kinds, specs, at("first"), {"revision": "r"}, form="vectors-and-records", layout="parts")
    generation = interchange.import_index(spark, at("first"), at("index"), ("vectors-and-records",))
    interchange.export_interchange(spark, generation, at("second"))
    again = interchange.import_interchange(spark, at("second"), at("index"), 2, ("vectors-and-records",))
    interchange.prune(at("index"))
    interchange.export_generation(spark, again, at("shipped"))
    live = interchange.import_index(spark, at("shipped"), at("other"))
    out = None
    for kind in kinds:
        part = interchange.open_corpus(spark, live, kind).select("id", "kind", "ord", F.sha2("src", 256).alias("src"), "entry", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.size("vector").cast("long").alias("dimension"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT count(*) AS held, count(*) FILTER (WHERE vec_id % 2 = 0) AS now, 0::BIGINT AS pruned_while_held, 1::BIGINT AS pruned_after, 'v' || min(vec_id) FILTER (WHERE vec_id % 2 = 0) AS point FROM embeddings")
def live_generation(spark, sf_dir):
    """A reader holds a generation while another is published and old ones are pruned; then it is gone. The new one is read at one point."""
    rows = _corpus(spark, sf_dir).select(F.col("id").alias("ord"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), F.lit("all").alias("kind"), F.lit("source").alias("src"), "entry", F.lit("said").alias("llm_description"), F.lit("said").alias("embedding_input"), "vector")
    spec = {"all": {"dimension": 64, "metric": "cosine", "recipe": {"model": "m", "add_metadata": False, "prompts": {"embed": "{doc_src}"}}}}
    base = _folder(spark)
    first = rows.agg(F.min(F.when(F.col("ord") % 2 == 0, F.col("ord")))).first()[0]
    for name, some in (("a", rows), ("b", rows.where("ord % 2 = 0"))):
        interchange.write_interchange({"all": some}, spec, os.path.join(base, name), layout="parts")
    index = os.path.join(base, "index")
    interchange.import_interchange(spark, os.path.join(base, "a"), index)
    live = Live(spark, index)
    with live.held("all") as corpus:
        interchange.import_interchange(spark, os.path.join(base, "b"), index)
        kept, held = len(interchange.prune(index)), corpus.count()
    gone = len(interchange.prune(index))
    now = live.corpus("all")
    return spark.createDataFrame([(held, now.count(), kept, gone, interchange.point(now, f"v{first}").first().id)], "held long, now long, pruned_while_held long, pruned_after long, point string")


@query("SELECT 'vectors.f32' AS file, (256 * count(*) // 2) // 65536 AS chunk, 'changed' AS fault FROM embeddings")
def spoilt_chunk(spark, sf_dir):
    """One byte amid all vectors is changed after their chunks were digested; tasks find the chunk."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = _corpus(spark, sf_dir).join(docs, "id", "left").select(F.col("id").alias("ord"), F.to_json(F.struct("id", "text")).alias("record"), "vector")
    base = _folder(spark)
    ranges.put_together(spark, base, ranges.write_parts(rows, base), {"jsonl": "documents.jsonl", "f32": "vectors.f32"})
    files = Files(spark, base).walk()
    folder = shared_folder(spark)
    ranges.digests(base, ranges.chunks(spark, files, 65536)).write.parquet(folder)
    at = next(size for name, size in files if name == "vectors.f32") // 2
    path = os.path.join(ranges.local_path(base), "vectors.f32")
    with open(path, "r+b") as f:
        f.seek(at)
        old = f.read(1)
        f.seek(at)
        f.write(bytes([old[0] ^ 1]))
    return ranges.faults(spark.read.parquet(folder), ranges.digests(base, ranges.chunks(spark, files, 65536)))


@query("SELECT vec_id, 4 * len(embedding) AS n_bytes, round(embedding[1]::DOUBLE, 6) AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def vector_bytes(spark, sf_dir):
    raw = _table(spark, sf_dir, "embeddings").select("vec_id", bytes_of_floats("embedding").alias("raw"))
    back = raw.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), floats_of_bytes("raw").alias("v"))
    return back.select("vec_id", "n_bytes", F.round(F.col("v")[0].cast("double"), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("SELECT vec_id, i - 1 AS ord, CASE i WHEN 1 THEN 'first' ELSE 'second' END AS input, round(CASE i WHEN 1 THEN embedding[1] ELSE embedding[2] END::DOUBLE, 6) AS head FROM embeddings, (VALUES (1), (2)) t(i)")
def reference_zip(spark, sf_dir):
    """Reference inputs and their vectors, place by place."""
    e = F.col("embedding").cast("array<double>")
    lists = _table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.lit("first"), F.lit("second")).alias("inputs"), F.array(F.slice(e, 1, 1), F.slice(e, 2, 1)).alias("vectors"))
    one = validate.zipped(lists, keep=("vec_id",))
    return one.select("vec_id", F.col("ord").cast("long").alias("ord"), "input", F.round(F.col("vector")[0], 6).alias("head"))


@query("SELECT event_id AS id, event_type AS command, NULL::INTEGER AS start_line FROM events WHERE event_type IN ('click', 'purchase')")
def selected_blocks(spark, sf_dir):
    """Events as source blocks, two commands of them, in the fixed fields."""
    blocks = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("command"), F.col("props").alias("src"))
    return interchange.block_fields(build.select_blocks(blocks, ["click", "purchase"])).select("id", "command", "start_line")


@query("SELECT s_suppkey::VARCHAR AS \"ID\", 'a \"' || s_name || '\",' || chr(10) || s_nationkey AS query FROM supplier")
def benchmark_csv(spark, sf_dir):
    """Suppliers as a CSV with quotes, commas and line breaks, read back."""
    folder = shared_folder(spark)
    text = F.concat(F.lit('a "'), "s_name", F.lit('",\n'), F.col("s_nationkey").cast("string"))
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ID"), text.alias("query"))
    rows.write.options(header=True, quote='"', escape='"').csv(folder)
    return interchange.read_benchmark_csv(spark, folder)


@query("SELECT n_name AS entry, 'Title of ' || n_name AS title, coalesce(r_name, '') AS abstract, '2020-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS date FROM nation JOIN region ON n_regionkey = r_regionkey")
def metadata_files(spark, sf_dir):
    """Nations as TOML files, written and read by tasks."""
    folder = _folder(spark)
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.format_string('title = "Title of %s"\nabstract = "%s"\ndate = 2020-01-%02d\n', "n_name", "r_name", F.col("n_nationkey").cast("int") + 1)
    ranges.write_files(nations.select(F.concat("n_name", F.lit(".toml")).alias("name"), text.alias("text")), folder)
    return interchange.read_metadata(spark, folder)


@query("SELECT r_name AS kind, CASE WHEN r_regionkey % 2 = 0 THEN 'own ' || r_name ELSE 'common' END AS prompt FROM region")
def prompt_files(spark, sf_dir):
    """Prompts of regions: some have their own."""
    folder, regions = _folder(spark), _table(spark, sf_dir, "region")
    own = regions.where("r_regionkey % 2 = 0").select(F.concat(F.lit("embed_"), "r_name", F.lit(".txt")).alias("name"), F.concat(F.lit("own "), "r_name").alias("text"))
    common = regions.limit(1).select(F.lit("embed.txt").alias("name"), F.lit("common").alias("text"))
    ranges.write_files(own.unionByName(common), folder)
    return interchange.prompts_for(ranges.read_files(spark, folder, ".txt"), "embed", regions.select(F.col("r_name").alias("kind")))


# --- searches -------------------------------------------------------------------------------------------------------------



def _word(w: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_'']){w}($|[^\p{{L}}\p{{N}}_''])"



@query(
    f"""WITH {_V}, near AS (SELECT id, entry, round(greatest(0.0, list_cosine_distance((SELECT e FROM v WHERE id = 0), e)), 9) AS d FROM v WHERE entry <> 'E3' AND (entry = '' OR entry IN ('E1', 'E2', 'E4')) ORDER BY d, id LIMIT 300)
SELECT id, entry, round(d, 6) AS distance FROM near JOIN documents ON id = doc_id WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') AND regexp_matches(text, '{_word("(the|and|que)")}') AND regexp_matches(text, '{_word("(of|to|de|und)")}') ORDER BY d, id LIMIT 7"""
)
def search_end_to_end(spark, sf_dir):
    """Prefilter, the 300 nearest, sessions and mentions, limit, without vectors."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session"), F.col("text").alias("src"))
    corpus = _corpus(spark, sf_dir).join(docs, "id", "left")
    marked = corpus.withColumn("src", F.concat(F.regexp_replace(F.regexp_replace("src", rf"(?<![\p{{L}}\p{{N}}_'])(the|and|que)(?![\p{{L}}\p{{N}}_'])", "first-mark"), rf"(?<![\p{{L}}\p{{N}}_'])(of|to|de|und)(?![\p{{L}}\p{{N}}_'])", "second-mark")))
    admit = SearchFilter(entries=frozenset({"E1", "E2", "E4"}), sessions=frozenset(f"src{i}" for i in range(6)), mentions=("first-mark", "second-mark"))
    found = search.search(marked, _vector(corpus, 0), 7, admit, exclude="E3", candidates=300)
    assert "vector" not in found.columns
    return found.select("id", "entry", _r6("distance"))


@query(f"WITH {_V} SELECT entry, count(*) AS n FROM v WHERE entry IN ('E1', 'E2') GROUP BY entry")
def restricted_filter(spark, sf_dir):
    """A filter from parameters, cut to what may be used, and back through its parameters."""
    admit = SearchFilter.of({"source": "contributed", "entries": "E1,E2,E3"}).restrict(["E2", "E1", "E9"], None)
    corpus = _corpus(spark, sf_dir)
    return corpus.where(SearchFilter.of(admit.parameters()).prefilter(F.col("entry"))).groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NEAR} SELECT query_id, rank::INTEGER AS rank, id, round(d, 6) AS distance FROM near WHERE rank <= 10")
def top_results(spark, sf_dir):
    """The first ten hits of each query, gathered as one list and shown a row each."""
    near = _near(spark, sf_dir).select("query_id", "id", _r6("distance"), "rank")
    lists = near.where("rank <= 10").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("top_results"))
    return lists.select("query_id", F.inline("top_results"))


@query(
    """WITH l AS (SELECT doc_id, doc_id % 9 + 1 AS start_line, string_split(text, chr(10)) AS lines FROM documents),
h AS (SELECT doc_id, start_line, list_filter(range(1, len(lines) + 1), lambda i: contains(lines[i], 'th')) AS places FROM l)
SELECT doc_id, list_sort(list_transform(places, lambda n: [abs(n - start_line), n]))[1][2]::INTEGER AS local_line FROM h"""
)
def local_lines(spark, sf_dir):
    """The line of the occurrence that is nearest to a given line."""
    docs = _table(spark, sf_dir, "documents")
    hits = docs.select("doc_id", F.col("doc_id").alias("file"), F.lit("th").alias("src"), (F.col("doc_id") % 9 + 1).alias("start_line"))
    files = docs.select(F.col("doc_id").alias("file"), F.col("text").alias("content"), F.lit("f").alias("local_file"))
    return search.with_local_lines(hits, files).select("doc_id", "local_line")


@query("""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/lib/a/' WHEN 1 THEN '/lib/../' WHEN 2 THEN '/other/' ELSE '/lib//' END || page_id AS file FROM pages) SELECT page_id FROM f WHERE page_id % 4 = 0 AND page_id % 3 <> 0""")
def trusted_local_files(spark, sf_dir):
    i = F.col("page_id")
    file = F.concat(F.when(i % 4 == 0, "/lib/a/").when(i % 4 == 1, "/lib/../").when(i % 4 == 2, "/other/").otherwise("/lib//"), i.cast("string"))
    pages = _table(spark, sf_dir, "pages").select("page_id", file.alias("file"))
    return search.trusted_files(pages, ["/lib"], pages.where("page_id % 3 <> 0")).select("page_id")


@query("SELECT lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, count(*) AS n FROM pages WHERE lower(regexp_extract(url, '://([^/:?#]*)', 1)) IN (SELECT min(lower(regexp_extract(url, '://([^/:?#]*)', 1))) FROM pages UNION ALL SELECT max(lower(regexp_extract(url, '://([^/:?#]*)', 1))) FROM pages) GROUP BY 1")
def allowed_hosts(spark, sf_dir):
    """Requests whose host is the first or the last by name."""
    hosts = _table(spark, sf_dir, "pages").select(T.host_name(F.concat(T.host_of_url(F.col("url")), F.lit(":80"))).alias("host"))
    names = hosts.agg(F.min("host").alias("a"), F.max("host").alias("b")).first()
    return hosts.where(F.col("host").isin("localhost", names.a, names.b)).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


# --- duplicates and reports -----------------------------------------------------------------------------------------------


@query(f"WITH {_NEAR} SELECT query_id, id FROM near WHERE rank <= 3 AND d <= 0.8")
def judged_prefix(spark, sf_dir):
    return _near(spark, sf_dir).where(duplicates.judged(F.col("rank"), F.col("distance"), weak=0.8)).select("query_id", "id")


@query(
    f"""WITH {_NEAR}, p AS (SELECT query_id, id, rank, d, rank <= 3 AND d <= 0.8 AS asked, length('A ' || trim(a.text[:3000], E' \\n\\t\\r') || ' B ' || trim(b.text[:3000], E' \\n\\t\\r')) AS n
  FROM near JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = id)
SELECT query_id, id, CASE WHEN asked AND n % 6 <> 0 THEN CASE n % 3 WHEN 1 THEN 'DUPLICATE' WHEN 2 THEN 'RELATED' ELSE 'VARIANT' END END AS verdict,
  CASE WHEN asked AND n % 6 <> 0 THEN CASE WHEN n % 3 = 0 THEN 'warmer of ' ELSE 'of ' END || n END AS justification,
  CASE WHEN asked AND n % 6 <> 0 THEN n % 3 = 2 END AS judge_truncated, asked AND n % 6 = 0 AS failed FROM p"""
)
def judge_verdicts(spark, sf_dir):
    """A model that tells by the prompt's length: a verdict, a verdict of a cut-off answer, or a cut-off answer without one, which is no use.

    Every second one of the last kind has a verdict at the second, warmer attempt; the others fail.
    """

    def model(prompt: str, temperature: float) -> build.Completion:
        n = len(prompt)
        if n % 3 == 0:
            return build.Completion(f"<BEGIN>VERDICT: variant warmer of {n}") if n % 6 and temperature > 0 else build.Completion("<BEGIN>VERD", True)
        return build.Completion(f"<BEGIN>VERDICT: {('duplicate', 'related')[n % 3 - 1]} of {n}", n % 3 != 1)

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    near = _near(spark, sf_dir)
    first = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("src"))
    pairs = near.join(first, "query_id").join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("other_src")), "id")
    out = build.judge(pairs, "A {first} B {second}", model, attempts=2, weak=0.8, sleep=lambda _: None)
    return out.select("query_id", "id", "verdict", "justification", "judge_truncated", F.col("judge_error").isNotNull().alias("failed"))


@query(f"""WITH {_TIERED}, shown AS (SELECT query_id, id, tier, text FROM tiered JOIN documents ON id = doc_id WHERE tier IN ('near-exact', 'possible'))
SELECT query_id, id, tier, CASE WHEN bool_or(tier = 'near-exact') OVER (PARTITION BY query_id) THEN 'near-exact' ELSE 'possible' END AS best_tier, left(text, 600) AS src FROM shown""")
def reported_view(spark, sf_dir):
    """A view of two tiers: items without a candidate are gone, best tiers are those of the view, sources are cut."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("src"))
    rows = _tiered(spark, sf_dir).drop("best_tier").join(docs, "id")
    return duplicates.reported(rows, tiers=("near-exact", "possible")).select("query_id", "id", "tier", "best_tier", "src")


@query(f"""WITH {_TIERED}, t AS (SELECT query_id, count(*) AS candidates, string_agg(id::VARCHAR || ':' || tier, ',' ORDER BY rank) AS listed FROM tiered WHERE tier IS NOT NULL GROUP BY query_id) SELECT * FROM t""")
def duplicate_evidence(spark, sf_dir):
    """All evidence as JSON, written with both views, and read again."""
    folder = _folder(spark)
    rows = _tiered(spark, sf_dir).select("query_id", "rank", "id", "distance", "tier", "verdict")
    evidence = report.duplicate_evidence({"all": (rows, {"aggregates": {}})}, {"strong": 0.55, "weak": 0.65})
    report.write_duplicates(folder, evidence, "Duplicates")
    items = interchange.read_json(os.path.join(folder, "duplicates.json"))["sections"]["all"]["items"]
    with open(os.path.join(folder, "possible.md"), encoding="utf-8") as f:
        assert f.read().count("\n### ") == len(items)
    told = [(x["id"], len(x["candidates"]), ",".join(f"{c['id']}:{c['tier']}" for c in x["candidates"])) for x in items]
    return spark.createDataFrame(told, "query_id long, candidates long, listed string")


@query(f"""WITH {_NEAR}, s AS (SELECT query_id, rank, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d + CASE WHEN id = query_id AND id % 100 = 0 THEN 1.0 ELSE 0 END, id) AS rank FROM pairs) WHERE id = query_id)
SELECT query_id, rank::INTEGER AS self_rank FROM s WHERE query_id % 100 = 0 AND rank <> 1 ORDER BY query_id LIMIT 20""")
def first_self_failures(spark, sf_dir):
    """Every second query's own distance is raised by 1, so that it fails unless it is first still; its place is counted, not read off a full ranking."""
    corpus = _corpus(spark, sf_dir)
    raised = _queries(corpus).where("query_id % 100 = 0").select("query_id", "vector", F.col("query_id").alias("own"), F.lit(1.0).alias("distance"))
    selfs = search.places(raised, corpus).select("query_id", F.col("rank").alias("self_rank"), F.lit(1.0).alias("self_distance"))
    return duplicates.first_failures(selfs).select("query_id", "self_rank")


@query("SELECT 'n' || n_nationkey AS target, 'title' AS query_type, 'where is ' || n_name AS query FROM nation WHERE n_nationkey % 5 <> 0")
def saved_query_file(spark, sf_dir):
    """A benchmark's result file with skipped targets, written, checked by its digest, and read."""
    folder = _folder(spark)
    rows = [r.asDict() for r in _table(spark, sf_dir, "nation").collect()]
    results = [{"target": f"n{r['n_nationkey']}", "query_type": "title", "metric": "rank", "value": 1, "query": f"where is {r['n_name']}", "source": "row", "top_results": [{"rank": 1, "distance": 0.5, "id": "x"}]} for r in rows if r["n_nationkey"] % 5]
    report.write_benchmark(folder, results, {"api_key": "secret"}, [{"query_type": "title", "metric": "rank", "average": 1.0, "sample_size": len(results)}], {f"n{r['n_nationkey']}": "Annotation: n" for r in rows if r["n_nationkey"] % 5 == 0})
    assert interchange.load_results(folder)["summary"] and interchange.read_json(os.path.join(folder, "manifest.json")) == {}
    path = os.path.join(folder, "results.json")
    with open(path, "rb") as f:
        found = evaluate.verified_saved_queries(f.read(), interchange.sha256_file(path))
    return spark.createDataFrame(found, "target string, query_type string, query string")


@query("SELECT doc_id, (lang = 'en' AND source = 'src1') OR lang = 'de' AS correct FROM documents")
def correct_results(spark, sf_dir):
    """Documents against partial ones: all pairs of one of them have to be there."""
    fields = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    targets = F.array(F.create_map(F.lit("lang"), F.lit("en"), F.lit("source"), F.lit("src1")), F.create_map(F.lit("lang"), F.lit("de")))
    return _table(spark, sf_dir, "documents").select("doc_id", evaluate.correct(fields, targets).alias("correct"))


@query("""WITH r AS (SELECT doc_id AS id, source AS title, lang AS plain FROM documents), s AS (SELECT doc_id AS id, 'q' || quality AS query FROM labels)
SELECT id, 'saved' AS query_type, query, 'saved' AS source FROM r JOIN s USING (id) UNION ALL SELECT id, 'title', title, 'row' FROM r ANTI JOIN s USING (id) UNION ALL SELECT id, 'natural', plain, 'row' FROM r ANTI JOIN s USING (id)""")
def saved_query_texts(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("natural"), F.lit("never").alias("third"))
    saved = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("saved").alias("query_type"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("query"))
    return evaluate.query_texts(rows, saved, ("title", "natural", "third"))


# --- prompts, names, keys -------------------------------------------------------------------------------------------------


def _words(column: str) -> str:
    return f"array_to_string(list_filter(string_split(regexp_replace(lower({column}), '\\b[a-z]{{1,3}}\\b|[^a-z ]', ' ', 'g'), ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)), ' ')"


@query(f"""WITH d AS (SELECT doc_id, trim(text[:3000], E' \\n\\t\\r') AS src, {_words("source || ' ' || lang")} AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_words('text')} END AS abstract FROM documents),
s AS (SELECT *, CASE WHEN length(title) + length(abstract) > 300 THEN abstract[:greatest(0, 297 - length(title))] || '...' ELSE abstract END AS short FROM d)
SELECT doc_id, sha256('T ' || CASE WHEN title = '' THEN '-- no title --' ELSE title END || ' A ' || CASE WHEN short = '' THEN '-- no abstract --' ELSE short END || ' S ' || src) AS prompt FROM s""")
def describing_prompt(spark, sf_dir):
    """An excerpt, and title and abstract within their joint limit."""
    docs = _table(spark, sf_dir, "documents")
    prompt = T.describe_prompt("T {title} A {abstract} S {theorem_content}", F.col("text"), F.concat_ws(" ", "source", "lang"), F.when(F.col("doc_id") % 3 != 0, F.col("text")))
    return docs.select("doc_id", F.sha2(prompt, 256).alias("prompt"))


@query("""SELECT doc_id, sha256('E: ' || lang || chr(10) || chr(10) || trim(text, E' \\n\\t\\r')) AS embedded, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE source || chr(10) || chr(10) || lang END AS query FROM documents""")
def embedded_texts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    modes = [T.combine_query(build.STRATEGIES[s][1], F.col("source"), F.col("lang")) for s in ("baseline", "R", "UR")]
    asked = F.when(F.col("doc_id") % 3 == 0, modes[0]).when(F.col("doc_id") % 3 == 1, modes[1]).otherwise(modes[2])
    return docs.select("doc_id", F.sha2(T.embedding_input("E: {doc_src}", F.col("lang"), F.col("text")), 256).alias("embedded"), asked.alias("query"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
u AS (SELECT doc_id, CASE WHEN length(x) % 2 = 0 THEN x ELSE regexp_replace(x, '\\([0-9]+\\)$', '') END AS name, min(i) AS i FROM w GROUP BY 1, 2)
SELECT doc_id, array_to_string(list(name ORDER BY i)[:20], ' ') AS names, greatest(count(*) - 20, 0)::INTEGER AS more FROM u GROUP BY doc_id""")
def compact_names(spark, sf_dir):
    """The first 20 distinct names without their numbers, and how many more there are."""
    words = F.transform(F.split("text", " "), lambda x: F.when(F.length(x) % 2 == 0, F.concat(x, F.lit("(1)"))).otherwise(x))
    shown, more = T.names(words, F.slice(words, 1, 2))
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(shown, " ").alias("names"), more.alias("more"))


@query("""SELECT event_id, '{"a":[1,2],"event":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"user":' || user_id || '}' AS canonical FROM events""")
def canonical_objects(spark, sf_dir):
    """Objects with their keys in another order and spaces, in canonical form."""
    text = F.concat(F.lit('{ "user": '), F.col("user_id").cast("string"), F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit(', "event": "'), F.col("event_type"), F.lit('", "a": [1, 2] }'))
    return _table(spark, sf_dir, "events").select("event_id", canonical_json(text).alias("canonical"))


@query("""SELECT doc_id, sha256(to_json(['b' || doc_id % 2, 'm', '{"a":1,"b":"x"}', text[:8000]])) AS key FROM documents""")
def call_keys(spark, sf_dir):
    """Keys of calls to two backends."""
    text = T.truncate(F.col("text"), build.EMBED_CHARS)
    key = F.when(F.col("doc_id") % 2 == 0, build.call_key(text, "m", "b0", {"b": "x", "a": 1})).otherwise(build.call_key(text, "m", "b1", {"a": 1, "b": "x"}))
    return _table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/lib/' WHEN 1 THEN '/lib/sub/' ELSE '/else/' END || page_id AS file FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN page_id::VARCHAR END AS relative, CASE WHEN page_id % 2 = 0 THEN 'E' || page_id ELSE CASE page_id % 3 WHEN 0 THEN 'Lib/' || page_id WHEN 1 THEN 'Lib/sub/' || page_id ELSE '/else/' || page_id END END AS label FROM p""")
def file_labels(spark, sf_dir):
    i = F.col("page_id")
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.when(i % 3 == 0, "/lib/").when(i % 3 == 1, "/lib/sub/").otherwise("/else/"), i.cast("string")).alias("file"))
    entry = F.when(i % 2 == 0, F.concat(F.lit("E"), i.cast("string"))).otherwise("")
    return pages.select("page_id", T.relative_to(F.col("file"), ["/lib/sub", "/lib/"]).alias("relative"), T.location_label(entry, F.concat("file", F.lit("|x")), "/lib/", "Lib/").alias("label"))


@query(f"SELECT doc_id, regexp_matches(text, '{_word('the')}') AS symbol, contains(text, '%%%') AS sign FROM documents")
def symbol_mentions(spark, sf_dir):
    """Tokens that a table of symbols decodes."""
    symbols = {"\\<the>": "the", "\\<sign>": "%%%"}
    return _table(spark, sf_dir, "documents").select("doc_id", T.mentions(F.col("text"), "\\<the>", symbols).alias("symbol"), T.mentions(F.col("text"), "\\<sign>", symbols).alias("sign"))


@query("SELECT page_id, sha256(array_to_string(list_transform(string_split(html, chr(10)), lambda x, i: i || ':' || x), chr(10))) AS lines FROM pages")
def all_numbered_lines(spark, sf_dir):
    lines = F.transform(search.numbered_lines(F.col("html")), lambda x: F.concat(x["number"].cast("string"), F.lit(":"), x["line"]))
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2(F.array_join(lines, "\n"), 256).alias("lines"))


# --- stores, sessions, checks ---------------------------------------------------------------------------------------------


@query("SELECT doc_id, 'said of ' || n AS text, n % 2 = 0 AS truncated FROM (SELECT doc_id, source, length(source || ' ' || text) AS n FROM documents) WHERE source <> 'src3'")
def described_through_store(spark, sf_dir):
    """Whole texts described by a chat service: each prompt is asked once, failures aren't kept; the second pass finds all but these in the store."""

    def service(url: str, headers: dict, body: dict) -> tuple[int, dict]:
        prompt = body["messages"][0]["content"]
        if prompt.startswith("src3 "):
            raise OSError("no answer")
        return 200, {"choices": [{"message": {"content": f"said of {len(prompt)}"}, "finish_reason": "stop" if len(prompt) % 2 else "length"}]}

    folder = shared_folder(spark, "store")
    prompt = F.concat_ws(" ", "source", "text")
    wanted = _table(spark, sf_dir, "documents").select("doc_id", prompt.alias("prompt"), build.call_key(prompt, "m", "b").alias("key"))
    model = build.generator(service, "http://x/", "m", sleep=lambda _: None)
    for _ in range(2):
        out = build.through_store(wanted, folder, lambda m: build.describe(m, model, attempts=1), F.col("status") != "failed")
    return out.select("doc_id", "text", "truncated")


@query("SELECT count(*) AS processed, 0::BIGINT AS reused, count(*) FILTER (WHERE user_id % 5 <> 0) AS generated, count(*) FILTER (WHERE user_id % 5 = 1) AS truncated, count(*) FILTER (WHERE user_id % 5 = 0) AS failed, round(count(*) / 8.0, 6) AS rate, round((2000000 - count(*)) / (count(*) / 8.0), 6) AS seconds_left FROM events")
def build_progress(spark, sf_dir):
    status = F.when(F.col("user_id") % 5 == 0, "failed").when(F.col("user_id") % 5 == 1, "truncated").otherwise("ok")
    statuses = _table(spark, sf_dir, "events").select(status.alias("status"))
    return build.progress(statuses, 8.0, 2_000_000).select("processed", "reused", "generated", "truncated", "failed", _r6("rate"), _r6("seconds_left"))


@query("SELECT doc_id, [length(left(text, 8000)), length(replace(left(text, 8000), 's', ''))]::FLOAT[] AS vector FROM documents")
def embedded_through_store(spark, sf_dir):
    """Whole texts, cut where the embedder's input ends, by an indexed service that refuses each batch once for now and then answers in reverse order."""
    refused: set[tuple[str, ...]] = set()

    def service(url: str, headers: dict, body: dict) -> tuple[int, dict]:
        if body["model"] != "m" or not url.endswith("/embeddings"):
            return 404, {}
        if tuple(body["input"]) not in refused:
            refused.add(tuple(body["input"]))
            return 429, {}
        refused.discard(tuple(body["input"]))
        data = [{"index": i, "embedding": [float(len(t)), float(len(t.replace("s", "")))]} for i, t in enumerate(body["input"])]
        return 200, {"data": data[::-1]}

    text = F.coalesce("text", F.lit(""))
    wanted = _table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), build.call_key(text, "m").alias("key"))
    model = build.embedder(service, "http://x/", "m", sleep=lambda _: None)
    out = build.through_store(wanted, shared_folder(spark, "store"), lambda m: build.embed(m, model, 7))
    return out.select("doc_id", "vector")


_TREE = """t AS (SELECT 'c' || c_custkey AS session, CASE WHEN c_custkey > 0 THEN 'c' || (c_custkey - 1) // 4 END AS parent, c_mktsegment AS grp, c_custkey AS k FROM customer),
up AS (SELECT session, parent AS above FROM t WHERE parent IS NOT NULL UNION ALL SELECT u.session, t.parent FROM up u JOIN t ON u.above = t.session WHERE t.parent IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_TREE}, d AS (SELECT session, count(*) AS depth FROM up GROUP BY session)
SELECT session, depth::INTEGER AS depth FROM t JOIN d USING (session) WHERE (grp IN ('MACHINERY') OR k % 3 = 0) AND session NOT IN ('c2', 'c7') AND session NOT IN (SELECT session FROM up WHERE above IN ('c2', 'c7'))""")
def selected_sessions(spark, sf_dir):
    """Customers as a tree of sessions: a group and a named set, without two subtrees, with their depth."""
    i = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    tree = _table(spark, sf_dir, "customer").select(name(i).alias("session"), F.when(i > 0, name(F.floor((i - 1) / 4))).alias("parent"), F.col("c_mktsegment").alias("group"))
    third = (F.substr("session", F.lit(2)).cast("int") % 3) == 0
    return build.select_sessions(tree, ["MACHINERY", "all-thirds"], ["c2", "c7"], "c0", {"all-thirds": third}).select("session", "depth")


@query("""WITH r AS (SELECT 'v' || o_orderkey || '-' || o_custkey % 5 AS tag, o_orderstatus = 'F' AS draft, o_orderkey % 7 = 0 AS pre, o_orderkey AS published, sha256(o_orderkey::VARCHAR) AS revision FROM orders),
a AS (SELECT 'v' || l_orderkey || '-' || o_custkey % 5 AS tag, bool_or(l_returnflag = 'R') AS summed, sum(l_quantity::BIGINT)::BIGINT AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
good AS (SELECT tag, revision, size, published FROM r JOIN a USING (tag) WHERE NOT draft AND NOT pre AND summed),
own AS (SELECT tag, revision, 0 AS distance, size FROM good UNION ALL SELECT tag, sha256('later ' || published), CASE WHEN published % 2 = 0 THEN 0 ELSE (published % 5)::INTEGER END, size FROM good WHERE published % 3 = 0)
SELECT tag, revision, distance, regexp_extract(tag, '^v(.*)-', 1) AS base, regexp_extract(tag, '-([0-9]+)$', 1)::INTEGER AS number, size FROM own""")
def covered_releases(spark, sf_dir):
    """Orders as releases, their items as assets, flag R as the checksums: final ones, their own revisions and those listed for them, and their tags' parts."""
    orders = _table(spark, sf_dir, "orders")
    tag = F.concat(F.lit("v"), F.col("o_orderkey").cast("string"), F.lit("-"), (F.col("o_custkey") % 5).cast("string"))
    own = orders.select(tag.alias("tag"), (F.col("o_orderstatus") == "F").alias("draft"), (F.col("o_orderkey") % 7 == 0).alias("prerelease"), F.col("o_orderkey").alias("published"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("revision"))
    items = _table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    assets = items.select(tag.alias("tag"), F.when(F.col("l_returnflag") == "R", "SHA256SUMS").otherwise("part").alias("name"), F.col("l_quantity").cast("long").alias("size"))
    good = releases.usable(own, assets)
    i = F.col("o_orderkey")  # every third order lists a later revision, with a distance or without; those of orders that aren't final don't count
    listed = orders.where(i % 3 == 0).select(F.sha2(F.concat(F.lit("later "), i.cast("string")), 256).alias("revision"), tag.alias("tag"), F.when(i % 2 != 0, (i % 5).cast("int")).alias("distance"))
    base, number = T.release_tag(F.col("tag"), "v")
    return releases.covered(good, listed).join(good.select("tag", "size"), "tag").select("tag", "revision", "distance", base.alias("base"), number.alias("number"), "size")


@query("""SELECT 'o' || o_orderkey AS revision, 's' || max_by(s_suppkey, s_suppkey) AS tag, (o_orderkey - max(s_suppkey) * 3)::INTEGER AS distance FROM orders JOIN supplier ON o_orderkey % 4 = s_suppkey % 4 AND s_suppkey * 3 <= o_orderkey GROUP BY o_orderkey""")
def extended_cover(spark, sf_dir):
    """Orders as changesets, suppliers as releases with the same sources."""
    new = _table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("number"), (F.col("o_orderkey") % 4).alias("fingerprint"))
    known = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("tag"), (F.col("s_suppkey") * 3).alias("number"), (F.col("s_suppkey") % 4).alias("fingerprint"))
    return releases.extend_cover(new, known)


@query("SELECT (SELECT count(*) FILTER (WHERE o_orderkey % 7 <> 0) FROM orders) AS published, (SELECT count(*) FILTER (WHERE o_orderkey % 7 = 0) FROM orders) AS local, (SELECT list(DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'README' ELSE o_orderstatus END ORDER BY CASE WHEN o_orderstatus = 'P' THEN 'README' ELSE o_orderstatus END) FROM orders) AS changed")
def checkout_state(spark, sf_dir):
    """Changesets beyond the covered one, those of our own, and the entries that they change."""
    orders = _table(spark, sf_dir, "orders")
    after = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "draft").otherwise("public").alias("phase"))
    path = F.when(F.col("o_orderstatus") == "P", "README").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("thys/"), F.col("o_orderstatus"), F.lit("/x/y"))).otherwise(F.concat(F.lit("metadata/entries/"), F.col("o_orderstatus"), F.lit(".toml")))
    return releases.changeset_counts(after, None, orders.select(path.alias("path")))


@query("SELECT s_suppkey, left(sha256(s_suppkey::VARCHAR), 12) AS revision FROM supplier")
def covering_revision(spark, sf_dir):
    """Short and full identifiers of the same revision."""
    sha = F.sha2(F.col("s_suppkey").cast("string"), 256)
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", F.substring(sha, 1, 12).alias("revision"), sha.alias("full"))
    return releases.choose(rows, F.col("full")).select("s_suppkey", "revision")


@query("SELECT count(DISTINCT len(embedding)) = 1 AS one_space, false AS two_spaces, (SELECT count(*) FROM embeddings) || ' vectors instead of 7' AS fault, true AS all_failed FROM embeddings")
def corpus_checks(spark, sf_dir):
    """Whether corpora share a space, whether counts are as told, whether a whole batch failed, and what a bad specification raises."""
    e = _table(spark, sf_dir, "embeddings")
    spec = e.select(F.size("embedding").alias("dimension"), F.lit("cosine").alias("metric"), F.lit("m").alias("model"), F.lit("p").alias("embed_prompt"), F.lit(10).alias("max_characters"))
    two = spec.unionByName(spec.withColumn("metric", F.lit("l2")))
    fault = validate.count_faults(spark.range(7), e, 7)
    failed = validate.batch_failed(_table(spark, sf_dir, "region").select(F.lit("failed").alias("status")))
    return spark.createDataFrame([(validate.same_space(spec), validate.same_space(two), "; ".join(fault), failed)], "one_space boolean, two_spaces boolean, fault string, all_failed boolean")


@query("""WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN '../b' WHEN 2 THEN 'a//b' WHEN 3 THEN '/a' ELSE 'a$b' END || page_id AS path FROM pages) SELECT page_id, page_id % 5 = 0 AS safe FROM n""")
def safe_paths(spark, sf_dir):
    """Paths of pages as names of files."""
    i = F.col("page_id")
    start = F.when(i % 5 == 0, "a/b").when(i % 5 == 1, "../b").when(i % 5 == 2, "a//b").when(i % 5 == 3, "/a").otherwise("a$b")
    return _table(spark, sf_dir, "pages").select("page_id", validate.is_safe_path(F.concat(start, i.cast("string"))).alias("safe"))


@query("SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN ['rest'] ELSE ['props', 'rest'] END AS names, CASE WHEN event_id % 3 = 0 THEN ['user'] ELSE [] END AS deep, props AS kept FROM events")
def redacted_settings(spark, sf_dir):
    """Events as settings, without their secrets at any depth."""
    i, props = F.col("event_id"), F.col("props")
    inner = F.array(F.create_map(F.when(i % 3 == 0, "user").otherwise("My_API_KEY"), props))
    top = F.create_map(F.when(i % 2 == 0, "Authorization").otherwise("props"), inner, F.lit("rest"), inner, F.lit("db_password"), inner)
    rows = _table(spark, sf_dir, "events").select(i.alias("id"), F.struct(top.alias("settings"), props.alias("token"), props.alias("kept")).alias("all"))
    public = rows.select("id", report.redacted(F.col("all"), rows.schema["all"].dataType).alias("all"))
    assert public.schema["all"].dataType.fieldNames() == ["settings", "kept"]
    return public.select("id", F.array_sort(F.map_keys("all.settings")).alias("names"), F.map_keys(F.col("all.settings")["rest"][0]).alias("deep"), "all.kept")


ORACLES["adler32_checksums"] = """WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents)
SELECT doc_id, ((len(b) + coalesce(list_sum(list_transform(b, lambda x, i: x * (len(b) - i + 1))), 0)) % 65521) * 65536 + (1 + coalesce(list_sum(b), 0)) % 65521 AS checksum FROM b"""
