"""The queries ``opN_<name>``: each operator with production parameters over its whole table, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id FROM sets
"""
)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), k=4, percent=85)


@query(
    f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id
"""
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .linedup import dedup_lines

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(documents, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokenfile import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, encode_special_tokens=False)


@query(
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), min_bytes=1000).drop("url")


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality import fit, held_out, score_documents

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@query(
    rf"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '{_ITEM_WORD}') AS w FROM benchmark),
wanted AS (
  SELECT item_id, least(5, len(w)) AS k, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS s
  FROM items WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS n FROM wanted GROUP BY item_id),
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '{_ITEM_WORD}') AS w FROM documents),
held AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM texts, (SELECT DISTINCT k FROM wanted) AS lengths WHERE len(w) >= k)
SELECT item_id, doc_id, n AS n_shingles, count(*) AS n_found, count(*)::DOUBLE / n AS containment
FROM wanted JOIN held USING (k, s) JOIN sizes USING (item_id) GROUP BY item_id, doc_id, n HAVING 100 * count(*) >= 80 * n
"""
)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_contained

    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .licenses import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentences", ",").alias("sentences"), F.size("sentences").alias("n_sentences"))


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk import quantised, top_inner_products

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_inner_products(vectors, F.col("vec_id") % 20 == 0, k=20)


@query()
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=50, columns=("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM conversations, crc),
rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds, range(2) AS copy(i) WHERE kind <> 0 AND (i = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn, trim(text, {_WHITE}) AS seen FROM rows),
flags AS (
  SELECT *, left(role, 1) AS initial, seen = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
    right(seen, 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM placed),
faults AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM flags GROUP BY conv_id),
inserts(state, mid, more, put) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
edits(mid, target, initial, price, letter) AS (VALUES (0, 1, 's', 0, 'K'), (0, 2, 'u', 0, 'K'), (1, 2, 'u', 0, 'K'), (3, 2, 'u', 0, 'K'), (2, 3, 'a', 0, 'K'),
  (0, 0, '', 0, 'K'), (1, 1, '', 0, 'K'), (2, 2, '', 0, 'K'), (3, 3, '', 0, 'K'), (0, 2, NULL, 2, 'R'), (1, 2, NULL, 2, 'R'), (3, 2, NULL, 2, 'R'), (2, 3, NULL, 2, 'R'),
  (0, 0, NULL, 3, 'D'), (1, 1, NULL, 3, 'D'), (2, 2, NULL, 3, 'D'), (3, 3, NULL, 3, 'D')),
ways AS (SELECT state, target, initial, more + price AS price, put || letter AS letters, letter FROM inserts JOIN edits USING (mid)),
dp AS (
  SELECT conv_id, 0::BIGINT AS rn, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM faults
  UNION ALL
  SELECT d.conv_id, d.rn + 1, w.target, min({{'cost': d.best.cost + w.price + CASE WHEN w.letter <> 'D' AND f.cut AND NOT f.blank AND NOT f.again THEN 1 ELSE 0 END, 'audit': d.best.audit || w.letters}})
  FROM dp d JOIN flags f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.rn = d.rn + 1
    JOIN ways w ON w.state = d.state AND (w.initial IS NULL OR w.initial = f.initial) AND (w.letter = 'D' OR NOT (f.blank OR f.again))
  GROUP BY d.conv_id, d.rn + 1, w.target),
ended AS (
  SELECT d.conv_id, min({{'cost': best.cost + e.more, 'audit': best.audit || e.put}}) AS best
  FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.rn JOIN (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) AS e(state, more, put) USING (state) GROUP BY d.conv_id),
letters AS (
  SELECT conv_id, unnest(range(1, length(best.audit) + 1)) AS p, substr(best.audit, p, 1) AS letter FROM ended),
numbered AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS rn FROM letters),
kept AS (
  SELECT n.conv_id, p, letter, CASE letter WHEN 'K' THEN role END AS role, CASE letter WHEN 'I' THEN '' ELSE text END AS text
  FROM numbered n LEFT JOIN flags f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.rn = n.rn WHERE letter <> 'D'),
spoken AS (
  SELECT *, count(*) FILTER (WHERE role IS NULL OR left(role, 1) NOT IN ('', 's')) OVER (PARTITION BY conv_id ORDER BY p) AS turn FROM kept),
repaired AS (
  SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS h FROM spoken GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repaired_conversations

    return repaired_conversations(table(spark, sf_dir, "conversations"))


@query()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256)


# On the given pages the article is an element of that name, so SQL can cut it out without a wrapper.
@query(
    r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS parts FROM a),
c AS (
  SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    x, '&quot;?', '"', 'g'), '&#x27;|&#39;', chr(39), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS texts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(texts, lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
)
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wrappers import extract

    return extract(table(spark, sf_dir, "pages"))
