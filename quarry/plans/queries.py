"""The engine's operators over the driver's tables, each beside SQL that says the same.

``documents`` are a corpus (source: entry, lang: kind), ``embeddings`` its vectors (label: entry, 0 the distribution), ``labels`` judgements,
``pages`` paths and URLs, ``conversations`` judgements' texts, ``events`` nested JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions import vector as V
from ..functions.arrow import adler32, ratio
from ..functions.json import typed
from ..operators import build, duplicates, evaluate, releases, search, validate
from ..operators.search import SearchFilter
from .catalog import query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label, entry): label 0 is the distribution."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.when(F.col("label") == 0, "").otherwise(F.concat(F.lit("E"), F.col("label").cast("string"))).alias("entry"))


def _vector(corpus: DataFrame, identifier: int) -> list[float]:
    return list(corpus.where(F.col("id") == identifier).select("vector").first()[0])


def _queries(corpus: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return corpus.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector", F.col("label").alias("query_label"), F.col("entry").alias("query_entry"))


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label, CASE WHEN label = 0 THEN '' ELSE 'E' || label END AS entry FROM embeddings)"
_COS = "greatest(0.0, list_cosine_distance({a}, {b}))"
_PAIRS = f"""{_V}, pairs AS (SELECT q.id AS query_id, c.id, c.label, c.entry, q.label AS query_label, q.entry AS query_entry, round({_COS.format(a='q.e', b='c.e')}, 9) AS d FROM v q, v c WHERE q.id % 50 = 0)"""
_NEAR = f"""{_PAIRS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs WHERE id <> query_id) WHERE rank <= 10)"""


def _near(spark: SparkSession, sf_dir: str, k: int = 10, metric: str = "cosine") -> DataFrame:
    """The 10 nearest others of each query, with both sides' labels."""
    corpus = _corpus(spark, sf_dir)
    q = _queries(corpus)
    found = search.knn_join(q, corpus, k, metric, exclude=("query_id", "id"))
    return found.join(corpus.select("id", "label", "entry"), "id").join(F.broadcast(q.select("query_id", "query_label", "query_entry")), "query_id")


def _r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# --- nearest neighbours ---------------------------------------------------------------------------------------------------


@query(f"WITH {_V} SELECT c.id, round({_COS.format(a='q.e', b='c.e')}, 6) AS distance FROM v c, (SELECT e FROM v WHERE id = 0) q ORDER BY round({_COS.format(a='q.e', b='c.e')}, 9), id LIMIT 10")
def knn_top10_cosine(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return search.nearest(corpus.select("id", "vector"), _vector(corpus, 0), 10).select("id", _r6("distance"))


@query(f"WITH {_V} SELECT c.id, round(pow(list_distance(q.e, c.e), 2), 6) AS distance FROM v c, (SELECT e FROM v WHERE id = 0) q ORDER BY pow(list_distance(q.e, c.e), 2), id LIMIT 10")
def knn_l2(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return search.nearest(corpus.select("id", "vector"), _vector(corpus, 0), 10, "l2").select("id", _r6("distance"))


@query(f"WITH {_PAIRS} SELECT query_id, id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INTEGER AS rank FROM pairs) WHERE rank <= 10")
def knn_join_ranked(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return search.knn_join(_queries(corpus), corpus, 10).select("query_id", "id", _r6("distance"), "rank")


_CASES = {
    "all": (SearchFilter(), "", "TRUE"),
    "distribution": (SearchFilter("distribution"), "", "entry = ''"),
    "contributed": (SearchFilter("contributed"), "", "entry <> ''"),
    "entries": (SearchFilter(entries=frozenset({"E1", "E2"})), "", "(entry IN ('E1', 'E2') OR entry = '')"),
    "contributed entries": (SearchFilter("contributed", frozenset({"E1", "E2"})), "", "entry IN ('E1', 'E2')"),
    "no entries": (SearchFilter("contributed", frozenset()), "", "FALSE"),
    "exclude": (SearchFilter(), "E3", "entry <> 'E3'"),
}


@query(f"WITH {_V}, d AS (SELECT id, entry, round({_COS.format(a='(SELECT e FROM v WHERE id = 0)', b='e')}, 9) AS d FROM v), " + ", ".join(f"c{i} AS (SELECT '{name}' AS filter, id, entry, d FROM d WHERE {sql} ORDER BY d, id LIMIT 10)" for i, (name, (_, _, sql)) in enumerate(_CASES.items())) + " " + " UNION ALL ".join(f"SELECT filter, id, entry, round(d, 6) AS distance FROM c{i}" for i in range(len(_CASES))))
def knn_prefilter_label(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    vector = _vector(corpus, 0)
    out = None
    for name, (admit, exclude, _) in _CASES.items():
        found = search.nearest(corpus.where(admit.prefilter(F.col("entry"), exclude)), vector, 10).select(F.lit(name).alias("filter"), "id", "entry", _r6("distance"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""WITH {_V}, near AS (SELECT id, round({_COS.format(a='(SELECT e FROM v WHERE id = 0)', b='e')}, 9) AS d FROM v ORDER BY d, id LIMIT 100)
SELECT id, round(d, 6) AS distance FROM near JOIN documents ON id = doc_id WHERE source IN ('src1', 'src2', 'src3', 'src4') AND regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_''])(the|und|que)($|[^\\p{{L}}\\p{{N}}_''])') ORDER BY d, id LIMIT 10""")
def knn_postfilter(spark, sf_dir):
    """Sessions and mentions see the 100 nearest only."""
    corpus = _corpus(spark, sf_dir)
    near = search.nearest(corpus.select("id", "vector"), _vector(corpus, 0), 100)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("session"), F.col("text").alias("src"))
    said = T.mentions(F.col("src"), "the") | T.mentions(F.col("src"), "und") | T.mentions(F.col("src"), "que")
    admit = SearchFilter(sessions=frozenset({"src1", "src2", "src3", "src4"}))
    return near.join(docs, "id").where(admit.admits(F.col("session"), F.col("src")) & said).orderBy("distance", "id").limit(10).select("id", _r6("distance"))


@query(f"""WITH {_PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY d, id) AS r FROM pairs WHERE entry <> query_entry)
SELECT query_id, id, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INTEGER AS rank FROM t WHERE r <= 10) WHERE rank <= 10""")
def knn_cross_kind_merge(spark, sf_dir):
    """Two kinds searched apart without the query's own entry, then one ranking."""
    corpus = _corpus(spark, sf_dir)
    parts = [search.knn_join(_queries(corpus), corpus.where(F.col("label") % 2 == kind), 10, exclude=("query_entry", "entry")) for kind in (0, 1)]
    return search.merge_targets(parts, 10).select("query_id", "id", _r6("distance"), "rank")


@query(f"""WITH {_PAIRS}, s AS (SELECT query_id, rank, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM pairs) WHERE id = query_id AND rank <= 311),
q AS (SELECT DISTINCT query_id FROM pairs), j AS (SELECT q.query_id, s.rank, s.d FROM q LEFT JOIN s USING (query_id))
SELECT count(*) AS documents, count(rank) AS retrieved, count(*) FILTER (WHERE rank IS NULL OR (rank <> 1 AND d > 0.05)) AS failures, round(avg(d), 6) AS mean_distance,
  round(count(*) FILTER (WHERE rank IS NULL OR (rank <> 1 AND d > 0.05)) / count(*), 6) AS fraction, count(*) FILTER (WHERE rank IS NULL OR (rank <> 1 AND d > 0.05)) / count(*) > 0.05 AS too_many FROM j""")
def self_retrieval(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    ranking = search.knn_join(_queries(corpus), corpus, 10 + C.SELF_EXTRA)
    out = duplicates.self_retrieval(duplicates.self_hits(ranking))
    return out.select("documents", "retrieved", "failures", _r6("mean_distance"), _r6("fraction"), "too_many")


# --- duplicate evidence ---------------------------------------------------------------------------------------------------

#: At these scales nothing is as near as the defaults ask; the shape of the evidence is the same.
_STRONG, _WEAK = 0.55, 0.65
_TIER = f"CASE WHEN d <= {_STRONG} THEN 'near-exact' WHEN verdict = 'DUPLICATE' THEN 'likely' WHEN d <= {_WEAK} THEN 'possible' END"
_VERDICT = "CASE WHEN rank <= 3 AND id % 3 = 0 THEN 'DUPLICATE' WHEN rank <= 3 THEN 'RELATED' END"
_TIERED = f"{_NEAR}, tiered AS (SELECT *, {_TIER} AS tier FROM (SELECT *, {_VERDICT} AS verdict FROM near))"
_ORDER = "CASE tier WHEN 'near-exact' THEN 1 WHEN 'likely' THEN 2 WHEN 'possible' THEN 3 END"
_BEST = f"best AS (SELECT query_id, query_label, CASE min({_ORDER}) WHEN 1 THEN 'near-exact' WHEN 2 THEN 'likely' WHEN 3 THEN 'possible' END AS best_tier FROM tiered GROUP BY ALL)"


def _tiered(spark, sf_dir) -> DataFrame:
    near = _near(spark, sf_dir)
    verdict = F.when((F.col("rank") <= 3) & (F.col("id") % 3 == 0), "DUPLICATE").when(F.col("rank") <= 3, "RELATED")
    near = near.withColumn("verdict", verdict).withColumn("judge_error", F.lit(None).cast("string"))
    return near.withColumn("tier", duplicates.classify(F.col("distance"), F.lit(None).cast("double"), F.col("verdict"), _STRONG, _WEAK))


def _best(spark, sf_dir) -> DataFrame:
    return _tiered(spark, sf_dir).groupBy("query_id", "query_label").agg(duplicates.best_tier(F.col("tier")).alias("best_tier"))


@query(f"WITH {_TIERED} SELECT query_id, id, verdict, tier FROM tiered")
def classify_pairs(spark, sf_dir):
    return _tiered(spark, sf_dir).select("query_id", "id", "verdict", "tier")


@query(f"WITH {_TIERED}, {_BEST} SELECT t.tier, count(b.query_id) AS n FROM (VALUES ('near-exact'), ('likely'), ('possible'), ('none')) t(tier) LEFT JOIN best b ON coalesce(b.best_tier, 'none') = t.tier GROUP BY t.tier")
def tier_counts(spark, sf_dir):
    return duplicates.tier_counts(_best(spark, sf_dir))


@query(f"WITH {_TIERED} SELECT count(*) FILTER (WHERE verdict = 'DUPLICATE') AS duplicate, 0::BIGINT AS variant, count(*) FILTER (WHERE verdict = 'RELATED') AS related, 0::BIGINT AS different, 0::BIGINT AS unknown, 0::BIGINT AS failures FROM tiered")
def verdict_counts(spark, sf_dir):
    return duplicates.verdict_counts(_tiered(spark, sf_dir))


@query(f"WITH {_TIERED} SELECT CASE label % 2 WHEN 0 THEN 'theorems' ELSE 'definitions' END AS kind, count(*) AS n FROM tiered WHERE tier IS NOT NULL GROUP BY 1")
def candidate_kind_counts(spark, sf_dir):
    return duplicates.kind_counts(_tiered(spark, sf_dir).withColumn("kind", F.when(F.col("label") % 2 == 0, "theorems").otherwise("definitions")))


@query(f"WITH {_NEAR} SELECT b.bucket, b.ord, count(n.query_id) AS n FROM (VALUES ('<= 0.05', 0, -1.0, 0.05), ('<= 0.1', 1, 0.05, 0.1), ('<= 0.2', 2, 0.1, 0.2), ('<= 0.3', 3, 0.2, 0.3), ('<= 0.5', 4, 0.3, 0.5), ('<= 1.0', 5, 0.5, 1.0), ('> 1.0', 6, 1.0, 9.0)) b(bucket, ord, lo, hi) LEFT JOIN near n ON n.rank = 1 AND n.d > b.lo AND n.d <= b.hi GROUP BY ALL")
def top1_distance_histogram(spark, sf_dir):
    return duplicates.histogram(_near(spark, sf_dir))


@query(f"WITH {_TIERED} SELECT entry, count(*) AS n FROM tiered WHERE tier IS NOT NULL AND entry <> '' GROUP BY entry ORDER BY n DESC, entry LIMIT 20")
def overlapping_groups_top20(spark, sf_dir):
    return duplicates.overlapping_entries(_tiered(spark, sf_dir))


@query(f"WITH {_TIERED}, {_BEST} SELECT 'E' || query_label AS entry, CASE query_label % 2 WHEN 0 THEN 'theorems' ELSE 'definitions' END AS kind, count(*) AS documents, count(*) FILTER (WHERE best_tier = 'near-exact') AS near_exact, count(*) FILTER (WHERE best_tier = 'likely') AS likely, count(*) FILTER (WHERE best_tier = 'possible') AS possible FROM best GROUP BY 1, 2")
def summary_pivot(spark, sf_dir):
    best = _best(spark, sf_dir).withColumn("entry", F.concat(F.lit("E"), F.col("query_label").cast("string"))).withColumn("kind", F.when(F.col("query_label") % 2 == 0, "theorems").otherwise("definitions"))
    return duplicates.entry_summary(best)


@query(f"WITH {_TIERED} SELECT count(DISTINCT query_id) AS items, count(*) AS pairs, count(*) FILTER (WHERE tier = 'near-exact') AS near_exact, count(*) FILTER (WHERE tier = 'likely') AS likely, count(*) FILTER (WHERE tier = 'possible') AS possible FROM tiered WHERE tier IN ('near-exact', 'likely')")
def view_totals(spark, sf_dir):
    return duplicates.view_totals(_tiered(spark, sf_dir).where(F.col("tier").isin("near-exact", "likely")))


@query(f"WITH {_TIERED} SELECT entry AS label, count(*) AS n, arg_max('u' || id, query_id * 100 + rank) AS url, min(query_id * 100 + rank) AS first FROM tiered GROUP BY entry ORDER BY n DESC, first LIMIT 20")
def match_locations(spark, sf_dir):
    rows = _tiered(spark, sf_dir).select(F.col("entry").alias("label"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), (F.col("query_id") * 100 + F.col("rank")).alias("ord"))
    return duplicates.match_locations(rows)


@query("SELECT sha256(text) AS key, count(*) AS size, min(doc_id) AS first, count(*) > 50 AS skipped FROM documents GROUP BY text HAVING count(*) >= 2")
def exact_duplicate_groups(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return duplicates.exact_copies(docs, F.sha2("text", 256))


@query()
def similarity_pairs(spark, sf_dir):
    """Sequence ratios of the whole texts of each query and its nearest, vector n being document n's."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = _near(spark, sf_dir, 3).select("query_id", "id")
    a, b = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("s")), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    texts = pairs.join(a, "query_id").join(b, "id")
    return duplicates.with_similarity(texts, "s", "t").withColumn("raw_ratio", ratio("s", "t")).select("query_id", "id", "syntactic_similarity", "raw_ratio")


@query()
def ground_truth_pairs(spark, sf_dir):
    """Documents that begin with the same three words, of different sources, with nearly the same statement."""
    first = F.concat(F.lit("T."), F.substring_index(F.substring_index("text", "\n", 1), " ", 3))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("source").alias("entry"), F.col("text").alias("src"), F.array(first).alias("consts"), F.array().cast("array<string>").alias("typs"))
    truth, _ = duplicates.ground_truth(docs, docs.select("id"))
    return truth


@query("SELECT name, count(*) AS size FROM (SELECT DISTINCT doc_id, unnest(list_transform(string_split(source || '.' || lang || ' ' || lang || '.x' || (doc_id % 7), ' '), lambda s: split_part(s, '.', -1))) AS name FROM documents) GROUP BY name")
def base_name_sizes(spark, sf_dir):
    names = F.split(F.concat("source", F.lit("."), "lang", F.lit(" "), "lang", F.lit(".x"), (F.col("doc_id") % 7).cast("string")), " ")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("entry"), names.alias("consts"), F.array().cast("array<string>").alias("typs"))
    return duplicates.base_name_sizes(docs)


@query(f"""WITH {_NEAR}, truth AS (SELECT a.id, b.id AS other FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id AND a.id % 50 = 0)
SELECT count(DISTINCT t.id) AS with_truth, count(DISTINCT n.query_id) AS recovered, round(count(DISTINCT n.query_id) / count(DISTINCT t.id), 6) AS recall FROM truth t LEFT JOIN near n ON n.query_id = t.id AND n.id = t.other""")
def truth_recall(spark, sf_dir):
    """How many queries find a vector with their own label; labels are counted, their pairs are never made."""
    corpus = _corpus(spark, sf_dir)
    sizes = corpus.groupBy(F.col("label").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    found = duplicates.recall_by_group(_queries(corpus).select("query_id", F.col("query_label").alias("group")), sizes, _near(spark, sf_dir).select("query_id", "id", F.col("label").alias("group")))
    return found.select("with_truth", "recovered", _r6("recall"))


@query("SELECT 'C' || o_custkey AS entry, strftime(max(o_orderdate), '%Y-%m-%d') AS date FROM orders GROUP BY o_custkey ORDER BY max(strftime(o_orderdate, '%Y-%m-%d')) DESC, entry DESC LIMIT 10")
def newest_entries(spark, sf_dir):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    docs = _table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entry"), date.alias("entry_date"), F.struct("o_orderdate", "o_orderkey").alias("ord"))
    return duplicates.newest_entries(docs, 10)


@query("SELECT entry, ord, CASE WHEN entry IN (SELECT source FROM documents) THEN 'found' ELSE 'missing' END AS status FROM (VALUES ('src3', 0), ('src1', 1), ('nowhere', 2), ('src99999', 3)) t(entry, ord)")
def missing_entries(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("entry"))
    found, missing = duplicates.requested_entries(["src3", "src1", "src3", "nowhere", "src99999", "nowhere"], docs)
    return found.withColumn("status", F.lit("found")).unionByName(missing.withColumn("status", F.lit("missing")))


# --- copies ---------------------------------------------------------------------------------------------------------------


@query("""WITH h AS (SELECT doc_id AS id, CASE WHEN source = 'src0' THEN '' ELSE source END AS entry, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
f AS (SELECT *, min(rank) OVER (PARTITION BY key) AS first FROM h), g AS (SELECT *, dense_rank() OVER (ORDER BY first) AS grp FROM f),
s AS (SELECT * FROM g WHERE rank < coalesce((SELECT min(rank) FROM g WHERE grp = 201), 1e18)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY entry <> '', rank) AS place FROM s)
SELECT grp::INTEGER AS place, max(id) FILTER (WHERE place = 1) AS id, coalesce(list(id ORDER BY rank) FILTER (WHERE place > 1), []) AS copies FROM r GROUP BY grp""")
def collapse_copies(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    hits = docs.select(F.lit(0).alias("query_id"), F.col("doc_id").alias("id"), F.when(F.col("source") == "src0", "").otherwise(F.col("source")).alias("entry"), T.trim(T.normalise_space(F.col("text"))).alias("key"), (-F.col("n_chars")).alias("long"))
    out = search.collapse(hits, 200, ("long", "id"))
    return out.select("place", "id", F.transform("copies", lambda x: x["id"]).alias("copies"))


# --- text functions -------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_''])the($|[^A-Za-z0-9_''])') THEN regexp_extract(text, '^((?s:.*?)(?:^|[^A-Za-z0-9_'']))the(?:$|[^A-Za-z0-9_''])', 1) ELSE text END) AS stripped FROM documents""")
def strip_token(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.strip_from_token(F.col("text"), "the"), 256).alias("stripped"))


@query("""WITH p AS (SELECT doc_id, 'lemma n' || doc_id || ' [simp]: ' || replace(text, 'and', 'proof') AS src FROM documents),
s AS (SELECT doc_id, CASE WHEN regexp_matches(src, '[^A-Za-z0-9_'']proof($|[^A-Za-z0-9_''])') THEN regexp_extract(src, '^((?s:.*?)[^A-Za-z0-9_''])proof(?:$|[^A-Za-z0-9_''])', 1) ELSE src END AS src FROM p)
SELECT doc_id, sha256(trim(regexp_replace(substr(src, position(']: ' IN src) + 2), '[\\t-\\r\\x{85}\\p{Z}]+', ' ', 'g'))) AS statement FROM s""")
def statement_normalise(spark, sf_dir):
    """Documents as source blocks: command, name and attributes before, a proof somewhere in them."""
    docs = _table(spark, sf_dir, "documents")
    src = F.concat(F.lit("lemma n"), F.col("doc_id").cast("string"), F.lit(" [simp]: "), F.replace(F.col("text"), F.lit("and"), F.lit("proof")))
    return docs.select("doc_id", F.sha2(T.statement(src), 256).alias("statement"))


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS) + "]"


@query(f"""SELECT doc_id, sha256(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(text), '\\b[a-z]{{1,3}}\\b|[^a-z ]', ' ', 'g'), '', ''), ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x)), ' ')) AS words FROM documents""")
def metadata_stopwords(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.metadata_words(F.col("text")), 256).alias("words"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^\\p{L}\\p{N}_''])the($|[^\\p{L}\\p{N}_''])') AS the, contains(text, '###') AS marks FROM documents")
def mentions_filter(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.mentions(F.col("text"), "the").alias("the"), T.mentions(F.col("text"), "###").alias("marks"))


@query("SELECT doc_id, sha256(text[:600]) AS cut, sha256(text) AS whole FROM documents")
def truncate_sha256(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.truncate(F.col("text"), 600), 256).alias("cut"), F.sha2("text", 256).alias("whole"))


@query("SELECT doc_id, sha256('Title: ' || source || '\n{' || lang || '}: ' || trim(text, E' \\n\\t\\r') || CASE WHEN quality IS NULL THEN ' -- no label --' ELSE ' ' || quality END) AS prompt FROM documents LEFT JOIN labels USING (doc_id)")
def prompt_template(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("quality").isNull(), "-- no label --").otherwise(F.col("quality").cast("string"))
    text = T.template("Title: {title}\n{{{lang}}}: {text} {label}", title=F.col("source"), lang=F.col("lang"), text=T.trim(F.col("text")), label=label)
    return docs.select("doc_id", F.sha2(text, 256).alias("prompt"))


@query("""WITH t AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'x<BEGIN>VERDICT: duplicate as ' || text || '<END>z' WHEN 1 THEN 'VERDICT : Related. ' || text WHEN 2 THEN 'verdict: none ' || text ELSE 'VERDICT: what ' || text END AS raw FROM conversations),
m AS (SELECT *, CASE WHEN contains(raw, '<BEGIN>') THEN split_part(split_part(raw, '<BEGIN>', 2), '<END>', 1) ELSE raw END AS said FROM t)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'DUPLICATE' WHEN 1 THEN 'RELATED' ELSE 'UNKNOWN' END AS verdict,
  left(CASE WHEN turn % 4 IN (0, 1) THEN trim(regexp_replace(said, '^VERDICT\\s*:\\s*[A-Za-z]+', ''), E' \\n\\t\\r') ELSE trim(said, E' \\n\\t\\r') END, 300) AS reason FROM m""")
def verdict_parse(spark, sf_dir):
    """Conversations' texts as what a judge says for its verdict, marked, plain, misspelt and unknown."""
    i, text = F.col("turn") % 4, F.col("text")
    raw = F.when(i == 0, F.concat(F.lit("x<BEGIN>VERDICT: duplicate as "), text, F.lit("<END>z"))).when(i == 1, F.concat(F.lit("VERDICT : Related. "), text)).when(i == 2, F.concat(F.lit("verdict: none "), text)).otherwise(F.concat(F.lit("VERDICT: what "), text))
    word, reason = T.verdict(raw)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", word.alias("verdict"), reason.alias("reason"))


@query("SELECT page_id, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS entry, lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS host, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages")
def url_parts(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    q = T.url_parameters(F.parse_url("url", F.lit("QUERY")))
    return pages.select("page_id", F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("entry"), T.host_of_url(F.col("url")).alias("host"), F.coalesce(F.element_at(q, "page"), F.lit("")).alias("page"), F.coalesce(F.element_at(q, "ref"), F.lit("")).alias("ref"))


@query("SELECT page_id, 'lib' || regexp_extract('/x/thys/' || url, '/thys/([^/]*)', 1) AS entry, regexp_replace(lower(trim(' ' || split_part(split_part(url, '://', 2), '/', 1) || ':8080 ')), ':[0-9]*$', '') AS host FROM pages")
def entry_from_path(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    header = F.concat(F.lit(" "), F.substring_index(F.substring_index("url", "://", -1), "/", 1), F.lit(":8080 "))
    return pages.select("page_id", F.concat(F.lit("lib"), T.entry_of(F.concat(F.lit("/x/thys/"), F.col("url")))).alias("entry"), T.host_name(header).alias("host"))


@query("""WITH n AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS name FROM pages)
SELECT page_id, split_part(name, '.', -1) AS base, CASE WHEN len(string_split(name, '.')) > 2 THEN array_to_string(string_split(name, '.')[2:-2], '.') END AS qualifier, list_distinct([split_part(name, '.', -1), 'x'])[1] IS NOT NULL AS named FROM n""")
def declared_names(spark, sf_dir):
    """Host names as dotted names, the first component as the theory."""
    name = F.substring_index(F.substring_index("url", "://", -1), "/", 1)
    pages = _table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    theory = F.concat(F.lit("S."), F.substring_index("name", ".", 1))
    own = T.qualifier(theory, F.array("name"), F.array().cast("array<string>"))
    return pages.select("page_id", T.base_name(F.col("name")).alias("base"), own.alias("qualifier"), (F.size(T.truth_names(F.array("name"), F.array(F.lit("a.x")))) > 0).alias("named"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, length(props)::BIGINT AS size FROM events")
def json_props(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("size"))


@query("SELECT page_id, len(string_split(html, chr(10))) AS lines, sha256(string_split(html, chr(10))[-1]) AS last FROM pages")
def numbered_lines(spark, sf_dir):
    lines = search.numbered_lines(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.element_at(lines, -1)["number"].cast("long").alias("lines"), F.sha2(F.element_at(lines, -1)["line"], 256).alias("last"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id ELSE 'f' || lang || '|e' || source END AS identity, CASE WHEN source = 'src0' THEN 'https://lib.example/x' ELSE '' END AS theory_url, CASE WHEN source = 'src0' THEN '' ELSE 'https://e.example/' || source || '.html' END AS entry_url, CASE WHEN source = 'src0' THEN '' ELSE 'https://s.example/' || source || '/t#L' || doc_id END AS remote_url FROM documents")
def identities_and_links(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("e"), F.col("source")))
    entry = F.when(F.col("source") == "src0", "").otherwise(F.col("source"))
    made = T.links(entry, F.lit("x"), F.concat(entry, F.lit("/t")), F.col("doc_id"), "https://lib.example/", "https://e.example", "https://s.example/")
    return docs.select("doc_id", T.identity(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("f"), F.col("lang")), name).alias("identity"), *(c.alias(n) for n, c in made.items()))


@query()
def adler32_checksums(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", adler32("text").alias("checksum"))


# --- evaluation -----------------------------------------------------------------------------------------------------------

_MET = f"""{_NEAR}, n AS (SELECT id AS query_id, (SELECT count(*) FROM v b WHERE b.label = a.label AND b.id <> a.id) AS n_targets FROM v a WHERE id % 50 = 0),
p AS (SELECT query_id, count(*) AS n_results, min(CASE WHEN label = query_label THEN rank END) AS first, sum(CASE WHEN label = query_label THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM near GROUP BY query_id),
met AS (SELECT query_id, CASE WHEN first <= 10 THEN 1 ELSE 0 END AS top_k_accuracy, CASE WHEN n_targets = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, n_targets + 1), lambda r: 1 / log2(r + 1))) END AS ndcg, coalesce(1.0 / first, 0) AS rr, coalesce(first, n_results) AS rank FROM n JOIN p USING (query_id))"""


def _metrics(spark, sf_dir, metric: str = "cosine") -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    near = _near(spark, sf_dir, metric=metric).withColumn("relevant", F.col("label") == F.col("query_label"))
    sizes = corpus.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_targets"))
    targets = _queries(corpus).join(F.broadcast(sizes), F.col("query_label") == F.col("label")).select("query_id", "n_targets")
    return evaluate.query_metrics(near, targets)


@query(f"WITH {_MET} SELECT query_id, top_k_accuracy, round(ndcg, 6) AS normalized_discounted_cumulative_gain, round(rr, 6) AS reciprocal_rank, rank FROM met")
def relevance_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", "top_k_accuracy", _r6("normalized_discounted_cumulative_gain"), _r6("reciprocal_rank"), "rank")


@query(f"""WITH {_MET}, long AS (SELECT 't' || (query_id % 3) AS query_type, unnest([{{'metric': 'top_k_accuracy', 'value': top_k_accuracy::DOUBLE}}, {{'metric': 'normalized_discounted_cumulative_gain', 'value': ndcg}}, {{'metric': 'reciprocal_rank', 'value': rr}}, {{'metric': 'rank', 'value': rank::DOUBLE}}], recursive := true) FROM met WHERE query_id // 50 % 4 <> 0)
SELECT coalesce(query_type, 'all_queries') AS query_type, metric, round(avg(value), 6) AS average, count(*) AS sample_size FROM long GROUP BY GROUPING SETS ((query_type, metric), (metric))""")
def metric_summary(spark, sf_dir):
    rows = evaluate.long_form(_metrics(spark, sf_dir), "query_id").withColumn("query_type", F.concat(F.lit("t"), (F.col("query_id") % 3).cast("string"))).withColumn("skipped", F.floor(F.col("query_id") / 50) % 4 == 0)
    return evaluate.metric_summary(rows).select("query_type", "metric", _r6("average"), "sample_size")


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two runs: ranked to ten and to three; some queries, texts and labels differ."""
    def run(k: int, without: int, changed: int) -> DataFrame:
        near = _near(spark, sf_dir).where(F.col("rank") <= k).withColumn("relevant", F.col("label") == F.col("query_label"))
        m = evaluate.query_metrics(near, near.select("query_id", F.lit(k).alias("n_targets")).distinct())
        i = F.floor(F.col("query_id") / 50)
        return m.where(i % 7 != without).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("target"), F.concat(F.lit("t"), (i % 3).cast("string")).alias("query_type"), F.when(i % 11 == changed, "new").otherwise("old").alias("query"), F.when(i % 13 == changed, "L").when(i % 13 < 5, "M").alias("label"), *evaluate.METRICS[:3])

    return run(10, 6, 2), run(3, 5, 3)


_RUN = "(SELECT 'q' || query_id AS target, 't' || (query_id // 50 % 3) AS query_type, CASE WHEN query_id // 50 % 11 = {c} THEN 'new' ELSE 'old' END AS query, CASE WHEN query_id // 50 % 13 = {c} THEN 'L' WHEN query_id // 50 % 13 < 5 THEN 'M' END AS label, coalesce(1.0 / min(CASE WHEN label = query_label THEN rank END), 0) AS rr, CASE WHEN min(CASE WHEN label = query_label THEN rank END) IS NULL THEN 0 ELSE 1 END AS hit, sum(CASE WHEN label = query_label THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, {k} + 1), lambda r: 1 / log2(r + 1))) AS ndcg FROM near WHERE rank <= {k} AND query_id // 50 % 7 <> {w} GROUP BY query_id, query_label)"
_RUNS = f"{_NEAR}, before AS (SELECT * FROM {_RUN.format(c=2, k=10, w=6)}), after AS (SELECT * FROM {_RUN.format(c=3, k=3, w=5)}), m AS (SELECT a.target, a.query_type, b.rr AS prr, a.rr AS crr, b.hit AS phit, a.hit AS chit, b.ndcg AS pn, a.ndcg AS cn FROM before b JOIN after a USING (target, query_type) WHERE a.query = b.query AND (a.label IS NULL OR b.label IS NULL OR a.label = b.label))"


@query(f"""WITH {_RUNS}, l AS (SELECT query_type, unnest([{{'metric': 'top_k_accuracy', 'p': phit::DOUBLE, 'c': chit::DOUBLE}}, {{'metric': 'normalized_discounted_cumulative_gain', 'p': pn, 'c': cn}}, {{'metric': 'reciprocal_rank', 'p': prr::DOUBLE, 'c': crr::DOUBLE}}], recursive := true) FROM m)
SELECT coalesce(query_type, 'All queries') AS query_type, metric, count(*) AS n, round(avg(p), 6) AS previous, round(avg(c), 6) AS current, round(avg(c) - avg(p), 6) AS delta FROM l GROUP BY GROUPING SETS ((query_type, metric), (metric))""")
def compare_runs(spark, sf_dir):
    before, after = _runs(spark, sf_dir)
    return evaluate.comparison_means(evaluate.matched_keys(before, after)).select("query_type", "metric", "n", _r6("previous"), _r6("current"), _r6("delta"))


@query(f"""WITH {_RUNS}, d AS (SELECT target, query_type, crr - prr AS delta FROM m), worse AS (SELECT 'worse' AS change, target, query_type, round(delta, 6) AS delta FROM d WHERE delta < 0 ORDER BY d.delta, target, query_type LIMIT 10),
better AS (SELECT 'better' AS change, target, query_type, round(delta, 6) AS delta FROM d WHERE delta > 0 ORDER BY d.delta DESC, target DESC, query_type DESC LIMIT 10)
SELECT * FROM worse UNION ALL SELECT * FROM better""")
def rank_changes(spark, sf_dir):
    worse, better = evaluate.changes(evaluate.matched_keys(*_runs(spark, sf_dir)))
    return worse.withColumn("change", F.lit("worse")).unionByName(better.withColumn("change", F.lit("better"))).select("change", "target", "query_type", _r6("delta"))


@query(f"WITH {_RUNS} SELECT 'previous' AS run, target, query_type FROM before ANTI JOIN after USING (target, query_type) UNION ALL SELECT 'current', target, query_type FROM after ANTI JOIN before USING (target, query_type)")
def only_in_one_run(spark, sf_dir):
    before, after = _runs(spark, sf_dir)
    return evaluate.only_in(before, after).withColumn("run", F.lit("previous")).unionByName(evaluate.only_in(after, before).withColumn("run", F.lit("current")))


@query("""WITH t AS (SELECT doc_id, doc_id % 9 = 0 AS skip, CASE doc_id % 7 WHEN 1 THEN '' WHEN 2 THEN 'no json' ELSE '[{"lang":"' || lang || '"}]' END AS target FROM documents)
SELECT CASE WHEN skip THEN 'Annotation: n' WHEN target = '' THEN 'target_identifier_missing' WHEN target = 'no json' THEN 'target_identifier_parse_error' WHEN target = '[{"lang":"de"}]' THEN 'target_document_not_found' END AS reason, count(*) AS n FROM t
WHERE skip OR target IN ('', 'no json', '[{"lang":"de"}]') GROUP BY 1""")
def skip_reasons(spark, sf_dir):
    """Documents as benchmark rows; German targets aren't in the corpus."""
    text = F.when(F.col("doc_id") % 7 == 1, "").when(F.col("doc_id") % 7 == 2, "no json").otherwise(F.concat(F.lit('[{"lang":"'), F.col("lang"), F.lit('"}]')))
    rows = _table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("target"))
    targets = evaluate.parse_targets(F.col("target"))
    reason = evaluate.skip_reason(F.when(F.col("doc_id") % 9 == 0, "true"), F.lit("n"), F.col("target"), targets, F.col("lang") != "de")
    rows = rows.withColumn("reason", reason).withColumn("skipped", F.col("reason") != "")
    return evaluate.skip_counts(rows)


@query("SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN 'src' || (item_id % 40) || '/' || (CASE WHEN item_id % 4 = 0 THEN 'en' ELSE 'de' END) ELSE 'fr' END AS target FROM benchmark b WHERE CASE WHEN item_id % 2 = 0 THEN EXISTS (SELECT 1 FROM documents d WHERE d.source = 'src' || (b.item_id % 40) AND d.lang = CASE WHEN b.item_id % 4 = 0 THEN 'en' ELSE 'de' END) ELSE EXISTS (SELECT 1 FROM documents WHERE lang = 'fr') END")
def present_targets(spark, sf_dir):
    """Partial documents that some document contains."""
    i = F.col("item_id")
    lang = F.when(i % 4 == 0, "en").otherwise("de")
    target = F.when(i % 2 == 0, F.create_map(F.lit("source"), F.concat(F.lit("src"), (i % 40).cast("string")), F.lit("lang"), lang)).otherwise(F.create_map(F.lit("lang"), F.lit("fr")))
    corpus = _table(spark, sf_dir, "documents").select(F.create_map(F.lit("source"), "source", F.lit("lang"), "lang", F.lit("id"), F.col("doc_id").cast("string")).alias("fields"))
    found = evaluate.present(_table(spark, sf_dir, "benchmark").select(target.alias("target")), corpus)
    return found.select(F.concat_ws("/", F.element_at("target", "source"), F.element_at("target", "lang")).alias("target"))


# --- joins and checks -----------------------------------------------------------------------------------------------------


_JSON = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{\"k\": \"' || event_type || '\"}' WHEN 2 THEN '{\"deep\": {\"k\": [' || event_id || ', true]}}' WHEN 3 THEN event_type || ' {' ELSE '{\"k\": null, \"deep\": 1.5}' END"


@query(
    f"""WITH t AS (SELECT event_id, {_JSON} AS text FROM events), k AS (SELECT event_id, text, json_valid(text) AS ok, CASE WHEN json_valid(text) THEN json_type(text, '$.k') END AS kind, CASE WHEN json_valid(text) THEN json_type(text, '$.deep.k[0]') END AS deep FROM t)
SELECT event_id, CASE WHEN kind IN ('UBIGINT', 'BIGINT') THEN (text->>'$.k')::BIGINT END AS k, CASE WHEN NOT ok THEN 'no JSON' WHEN kind IS NULL OR kind = 'NULL' THEN 'missing' WHEN kind NOT IN ('UBIGINT', 'BIGINT') THEN 'not a long' END AS k_error,
  CASE WHEN NOT ok THEN NULL WHEN kind IS NULL OR kind = 'NULL' THEN -1 WHEN kind IN ('UBIGINT', 'BIGINT') THEN (text->>'$.k')::BIGINT END AS k_or, CASE WHEN deep IS NOT NULL THEN (text->>'$.deep.k[0]')::DOUBLE END AS deep,
  CASE WHEN NOT ok THEN 'no JSON' WHEN deep IS NULL THEN 'missing' END AS deep_error FROM k"""
)
def typed_json(spark, sf_dir):
    """Right, wrong, missing, null and nested values of JSON texts, and texts that are no JSON."""
    rows = _table(spark, sf_dir, "events").select("event_id", F.expr(_JSON).alias("text"))
    k, k_or, deep = typed(F.col("text"), "$.k", "long"), typed(F.col("text"), "$.k", "long", F.lit(-1)), typed(F.col("text"), "$.deep.k[0]", "double")
    return rows.select("event_id", k.value.alias("k"), k.error.alias("k_error"), k_or.value.alias("k_or"), deep.value.alias("deep"), deep.error.alias("deep_error"))


@query("SELECT s_suppkey, coalesce(n_name, '') AS title, coalesce(r_name, '') AS abstract, '' AS date FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey AND n_nationkey % 5 <> 0")
def entry_metadata_join(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    meta = nations.select(F.col("n_nationkey").alias("entry"), F.col("n_name").alias("title"), F.col("r_name").alias("abstract"), F.lit(None).cast("string").alias("date"))
    docs = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("entry"))
    return build.with_metadata(docs, meta).select("s_suppkey", "title", "abstract", "date")


@query("WITH k AS (SELECT DISTINCT sha256(to_json([lang, text])) AS key FROM documents), s AS (SELECT DISTINCT sha256(to_json([lang, text])) AS key FROM documents WHERE doc_id % 3 = 0) SELECT count(*) AS misses FROM k ANTI JOIN s USING (key)")
def cache_misses(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("key", build.cache_key(F.col("lang"), F.col("text")))
    return build.misses(docs, docs.where("doc_id % 3 = 0").select("key").distinct()).agg(F.count(F.lit(1)).alias("misses"))


@query("SELECT count(*) AS n, 0::BIGINT AS empty_ids, 0::BIGINT AS missing_src, count(*) FILTER (WHERE lang <> 'en') AS wrong_kind, (SELECT coalesce(sum(m - 1), 0)::BIGINT FROM (SELECT count(*) AS m FROM documents GROUP BY text HAVING count(*) > 1)) AS repeated_ids FROM documents")
def integrity_checks(spark, sf_dir):
    """Texts as ids: some repeat; languages as kinds: some are wrong."""
    docs = _table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("id"), F.col("text").alias("src"), F.col("lang").alias("kind"))
    return validate.record_faults(docs, "en").select("n", "empty_ids", "missing_src", "wrong_kind", "repeated_ids")


@query("SELECT count(*) AS invalid FROM embeddings WHERE vec_id % 4 = 0 OR len(embedding) <> 64")
def vector_checks(spark, sf_dir):
    """Every fourth vector spoilt: one component is no number, or all are 0."""
    e = F.col("embedding")
    spoilt = F.when(F.col("vec_id") % 8 == 0, F.transform(e, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).when(F.col("vec_id") % 8 == 4, F.transform(e, lambda x: x * 0)).otherwise(e)
    return validate.vector_faults(_table(spark, sf_dir, "embeddings").select(spoilt.cast("array<float>").alias("vector")), 64).agg(F.count(F.lit(1)).alias("invalid"))


@query("WITH o AS (SELECT DISTINCT text AS i FROM documents), n AS (SELECT DISTINCT text AS i FROM documents WHERE doc_id % 4 <> 0) SELECT (SELECT count(*) FROM o ANTI JOIN n USING (i)) AS gone, (SELECT count(*) FROM o) AS before")
def prune_guard(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("id"), F.lit("").alias("file"), F.lit(None).cast("string").alias("entity_kname"))
    gone, before = validate.guard_pruning(docs, docs.where("doc_id % 4 <> 0"))
    return spark.createDataFrame([(gone, before)], "gone long, before long")


@query("WITH e AS (SELECT embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda v: round(v, 2)) AS y FROM embeddings) SELECT round(max(list_sum(list_transform(range(1, 65), lambda i: (y[i] - x[i]) * (y[i] - x[i]))) / greatest(list_dot_product(x, x), 1e-20)), 9) AS drift, max(list_sum(list_transform(range(1, 65), lambda i: (y[i] - x[i]) * (y[i] - x[i]))) / greatest(list_dot_product(x, x), 1e-20)) <= 0.001 AS ok FROM e")
def embedding_drift(spark, sf_dir):
    e = V.doubles(F.col("embedding"))
    vectors = _table(spark, sf_dir, "embeddings").select(F.transform(e, lambda x: F.round(x, 2)).alias("actual"), e.alias("expected"))
    return validate.embedding_drift(vectors).select(F.round("drift", 9).alias("drift"), "ok")


@query("SELECT p_partkey, bround_half AS price FROM (SELECT p_partkey, round_even(p_retailprice, 1) AS bround_half FROM part)")
def half_even_rounding(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", F.bround("p_retailprice", 1).alias("price"))


@query("SELECT c_mktsegment AS session, CASE WHEN bool_or(NOT t.has) THEN 'incomplete' ELSE 'complete' END AS state FROM (SELECT c_mktsegment, c_nationkey, bool_or(c_custkey % 5 = 0) AS has FROM customer GROUP BY ALL) t GROUP BY 1")
def incomplete_sessions(spark, sf_dir):
    """Segments as sessions, nations as theories: a theory needs a customer whose key 5 divides."""
    exports = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("session"), F.col("c_nationkey").alias("theory"), F.when(F.col("c_custkey") % 5 == 0, "id").otherwise("other").alias("name"))
    lacking = build.incomplete_sessions(exports, "id").withColumn("state", F.lit("incomplete"))
    return exports.select("session").distinct().join(lacking, "session", "left").withColumn("state", F.coalesce("state", F.lit("complete")))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'missing exports' ELSE o_orderpriority END AS reason, count(*) AS sessions, min(o_orderkey) AS first FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 3 = 0 GROUP BY 1")
def unbuilt_reasons(spark, sf_dir):
    """Orders as sessions: the finished ones are built, of which every third lacks exports."""
    orders = _table(spark, sf_dir, "orders")
    sessions = orders.select(F.col("o_orderkey").alias("session"), F.col("o_orderpriority").alias("error"))
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session"))
    return build.unbuilt_counts(build.unbuilt(sessions, done, done.where("session % 3 = 0")))


@query("WITH a AS (SELECT o_orderkey AS number, substr(sha256(o_orderkey::VARCHAR), 1, 12) AS node FROM orders WHERE o_orderkey % 2 = 0) SELECT sha256(s_suppkey::VARCHAR) AS revision, 'r' || s_suppkey AS tag, 0 AS distance, number FROM supplier JOIN a ON substr(sha256(s_suppkey::VARCHAR), 1, 12) = node ORDER BY number DESC LIMIT 1")
def newest_covered_ancestor(spark, sf_dir):
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    cover = _table(spark, sf_dir, "supplier").select(sha("s_suppkey").alias("revision"), F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("tag"), F.lit(0).alias("distance"), F.col("s_suppkey").alias("published"))
    ancestors = _table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.substring(sha("o_orderkey"), 1, 12).alias("node"), F.col("o_orderkey").alias("number"))
    return releases.newest_ancestor(cover, ancestors)


@query("SELECT count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS published, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS local FROM orders")
def changeset_counts(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    after = orders.select(F.col("o_orderkey").alias("id"), F.lit("public").alias("phase"))
    paths = orders.select(F.concat(F.lit("thys/"), F.col("o_orderstatus"), F.lit("/x")).alias("path"))
    return releases.changeset_counts(after, orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id")), paths).select("published", "local")


@query("WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS level FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY level DESC, l_linenumber) AS k FROM c) SELECT l_orderkey AS result_id, l_linenumber AS ord, level FROM r WHERE k = 1 AND level >= 1")
def most_available_copies(spark, sf_dir):
    """Line items as copies, return flags as sessions of some availability."""
    copies = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("session"))
    levels = spark.createDataFrame([("A", 2), ("N", 1)], "session string, level int")
    return search.most_available(copies, F.broadcast(levels), 1).select("result_id", "ord", "level")


@query("WITH r AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type FROM r WHERE k = 1")
def latest_event(spark, sf_dir):
    """The last value of each key."""
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
