"""The cell index: exact search against the exhaustive join, recall, filters, hot cells and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import index as ix
from quarry.operators.search import knn_join

SCHEMA = "id long, vector array<float>, label int"


def clustered(n, d=16, seed=0, hot=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, d)) * 4
    rows = [(i, [float(x) for x in (centres[i % 12] + r.standard_normal(d)).astype(np.float32)], i % 5) for i in range(n)]
    return rows + [(n + i, rows[0][1], 7) for i in range(hot)]


def answers(df):
    return sorted((r.query_id, r.rank, r.id, round(r.distance, 9)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_search_equals_the_exhaustive_join(spark, monkeypatch, metric):
    monkeypatch.setattr(ix, "PART_ROWS", 40)
    monkeypatch.setattr(ix, "QUERY_ROWS", 7)
    corpus = spark.createDataFrame(clustered(900, hot=400), SCHEMA).repartition(4)
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    index = ix.build(corpus, metric)
    assert index.parts.max() > 5  # the hot cell is in parts
    assert answers(ix.search(index, asked, 10)) == answers(knn_join(asked, corpus, 10, metric))
    where = F.col("label") == 3
    assert answers(ix.search(index, asked, 10, where)) == answers(knn_join(asked, corpus.where(where), 10, metric))
    rare = F.col("id") < 4  # fewer rows than asked for
    assert answers(ix.search(index, asked, 10, rare)) == answers(knn_join(asked, corpus.where(rare), 10, metric))


def test_probes_are_few_and_find_most_where_vectors_cluster(spark):
    corpus = spark.createDataFrame(clustered(3000), SCHEMA)
    asked = corpus.where("id % 30 = 0").select(F.col("id").alias("query_id"), "vector")
    index = ix.build(corpus)
    found, truth = ix.probe(index, asked, 10), knn_join(asked, corpus, 10)
    assert index.probes < len(index.centres) / 3
    assert ix.recall(found, truth).first()[0] >= 0.9
    assert index.rows().count() == 3000 and index.rows().select("shard").distinct().count() > 1


def test_more_probes_find_more(spark):
    corpus = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(np.random.default_rng(1).standard_normal((800, 24)))], SCHEMA)
    asked = corpus.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    index, truth = ix.build(corpus), knn_join(corpus.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vector"), corpus, 10)
    shares = [ix.recall(ix.probe(index, asked, 10, probes=n), truth).first()[0] for n in (1, 6, len(index.centres))]
    assert shares == sorted(shares) and shares[-1] == 1.0 and ix.recall(ix.probe(index, asked, 10), truth).first()[0] >= 0.9


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0], 0)], [(i, [0.5, 0.5], 0) for i in range(5)]])
def test_small_corpora(spark, rows):
    corpus = spark.createDataFrame(rows, SCHEMA)
    index = ix.build(corpus)
    asked = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, vector array<float>")
    assert [(r.id, r.rank) for r in ix.search(index, asked, 3).orderBy("rank").collect()] == [(r[0], i + 1) for i, r in enumerate(rows[:3])]
    assert ix.search(index, asked.limit(0), 3).count() == 0


def test_extra_columns_stay_and_unknown_metrics_raise(spark):
    corpus = spark.createDataFrame(clustered(60), SCHEMA).withColumn("note", F.lit("x"))
    assert {"id", "vector", "label", "note", "cell", "part"} <= set(ix.build(corpus).rows().columns)
    with pytest.raises(ValueError, match="unknown metric"):
        ix.build(corpus, "dot")


def test_cells_of_few_distinct_rows():
    centres = ix.fit_cells(np.repeat(np.eye(3), 10, axis=0), 8)
    assert len(centres) == 3 and np.allclose(sorted(map(tuple, centres)), sorted(map(tuple, np.eye(3))))
