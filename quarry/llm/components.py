"""Connected components of a graph held as a table of edges; neither edges nor labels ever come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_folder, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, component)``: each node that has an edge, and the smallest node it can reach.

    Alternates large-star and small-star steps, which keep components and end, in a number of
    rounds about the logarithm of the longest path, in one star around each smallest node. Each
    round is written to the shared folder. Self loops, repeated and null edges are ignored.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark)
    now = written(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), folder)
    while True:
        last = folder
        folder = shared_folder(spark)
        now = written(_small_star(_large_star(now)), folder)
        remove(spark, last)
        # stars only: no leaf has two centres, and no node is both a leaf and a centre
        leaves = now.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        inner = leaves.join(now.select(F.col("b").alias("a")), "a", "left_semi")
        if leaves.where("n > 1").unionByName(inner).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
