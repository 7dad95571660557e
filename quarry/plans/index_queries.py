"""Queries through the cell index, beside the exact answer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as ix
from .catalog import query
from .queries import _COS, _PAIRS, _V, _corpus, _queries, _r6


@query(f"WITH {_PAIRS} SELECT query_id, id, round(d, 6) AS distance, rank, TRUE AS probe_recall FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INTEGER AS rank FROM pairs) WHERE rank <= 10")
def index_search(spark, sf_dir):
    """The exact 10 nearest through the index, and whether one round of its probes alone finds at least nine in ten of them."""
    corpus = _corpus(spark, sf_dir)
    index = ix.build(corpus)
    asked = _queries(corpus).select("query_id", "vector")
    exact = ix.search(index, asked, 10)
    share = ix.recall(ix.probe(index, asked, 10), exact)
    return exact.join(F.broadcast(share)).select("query_id", "id", _r6("distance"), "rank", (F.col("recall") >= 0.9).alias("probe_recall"))


@query(
    f"""WITH {_V}, pairs AS (SELECT q.id AS query_id, c.id, c.entry, round({_COS.format(a='q.e', b='c.e')}, 9) AS d FROM v q, v c WHERE q.id % 50 = 0 AND c.entry IN ('E1', 'E2'))
SELECT query_id, id, entry, round(d, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INTEGER AS rank FROM pairs) WHERE rank <= 10"""
)
def index_search_filtered(spark, sf_dir):
    """The filter holds for the candidates of the probed cells, before the ranking."""
    corpus = _corpus(spark, sf_dir)
    index = ix.build(corpus)
    found = ix.search(index, _queries(corpus).select("query_id", "vector"), 10, F.col("entry").isin("E1", "E2"))
    return found.join(corpus.select("id", "entry"), "id").select("query_id", "id", "entry", _r6("distance"), "rank")
