"""Retrieval evaluation and comparison of runs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HIT_CUTOFF
from ..sources.shared import written

METRICS = ("top_k_accuracy", "normalized_discounted_cumulative_gain", "reciprocal_rank", "rank")


def correct(result: Column, targets: Column) -> Column:
    """Whether a result (map of strings) matches one of the targets (array of maps): it has all of that target's pairs."""
    return F.exists(targets, lambda t: F.forall(F.map_entries(t), lambda e: F.coalesce(F.element_at(result, e["key"]) == e["value"], F.lit(False))))


def present(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """Distinct ``targets(target map)`` that some row of ``corpus(fields map)`` contains. Maps are compared by their pairs.

    Of each row only the pairs that targets name are looked at, and rows with the same ones are one. A target is looked for by its pair that is
    rarest among these, so a pair that every row has is nobody's key, unless it is a target's only one: that is there already. An empty target is
    in any row, and in an empty corpus, too.
    """
    pairs = lambda m: F.array_sort(F.map_entries(m))
    distinct = targets.where("target IS NOT NULL").select(pairs(F.col("target")).alias("pairs")).distinct()
    named = distinct.select(F.explode("pairs").alias("pair")).distinct()
    rows = corpus.select("fields", F.monotonically_increasing_id().alias("at")).select("at", F.explode(F.map_entries("fields")).alias("pair"))
    seen = rows.join(named, "pair", "left_semi")
    # sets of pairs, each once: what rows have beside them, and copies, is gone here
    sets = written(seen.groupBy("at").agg(F.array_sort(F.collect_list("pair")).alias("has")).groupBy("has").agg(F.count(F.lit(1)).alias("n")))
    sizes = sets.select("n", F.explode("has").alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    counted = distinct.select("pairs", F.explode("pairs").alias("pair")).join(sizes, "pair", "left")
    keyed = counted.groupBy("pairs").agg(F.min_by("pair", F.struct(F.coalesce("n", F.lit(0)), "pair")).alias("key"), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0")
    alone = keyed.where(F.size("pairs") == 1).select("pairs")
    several = keyed.where(F.size("pairs") > 1).select("pairs", "key")
    holders = sets.select("has", F.explode("has").alias("key")).join(several.select("key").distinct(), "key", "left_semi")
    found = several.alias("t").join(holders.alias("s"), (F.col("t.key") == F.col("s.key")) & (F.size(F.array_except(F.col("t.pairs"), F.col("s.has"))) == 0), "left_semi")
    empty = distinct.where(F.size("pairs") == 0)
    return found.select("pairs").unionByName(alone).unionByName(empty).select(F.map_from_entries("pairs").alias("target"))


def query_metrics(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, metrics) from ``results(query_id, rank, relevant)`` and ``targets(query_id, n_targets)``.

    A query without a relevant result has the number of its results as its rank. The gain isn't cut off and can exceed 1,
    as several results can match one target.
    """
    gain = lambda rank: 1.0 / (F.log2(rank + 1))
    hit = F.when(F.col("relevant"), F.col("rank"))
    per = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results"), F.min(hit).alias("first"), F.sum(F.when(F.col("relevant"), gain(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    out = targets.join(per, "query_id", "left")
    ideal = F.aggregate(F.when(F.col("n_targets") > 0, F.sequence(F.lit(1), F.col("n_targets").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, r: s + gain(r))
    return out.withColumn("ideal", ideal).select(
        "query_id",
        F.when(F.col("first") <= HIT_CUTOFF, 1).otherwise(0).alias("top_k_accuracy"),
        F.when(F.col("ideal") == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("normalized_discounted_cumulative_gain"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce("first", "n_results", F.lit(0)).alias("rank"),
    )


def long_form(metrics: DataFrame, *keys: str, names: tuple[str, ...] = METRICS) -> DataFrame:
    """(keys, metric, value): a row for each metric."""
    return metrics.unpivot(list(keys), [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def metric_summary(rows: DataFrame) -> DataFrame:
    """(query_type, metric, average, sample_size) of ``rows(query_type, metric, value, skipped)`` for each type and for ``all_queries``."""
    kept = rows.where(~F.coalesce("skipped", F.lit(False)))
    sets = kept.groupingSets([["query_type", "metric"], ["metric"]], "query_type", "metric")
    return sets.agg(F.avg("value").alias("average"), F.count("value").alias("sample_size")).withColumn("query_type", F.coalesce("query_type", F.lit("all_queries")))


def parse_targets(text: Column) -> Column:
    """A JSON list of partial objects as maps; null if it isn't one."""
    parsed = F.from_json(text, "array<map<string,string>>")
    return F.when(F.trim(text).startswith("["), parsed)


def skip_reason(skip: Column, annotation: Column, target_text: Column, targets: Column, found: Column) -> Column:
    """Why a benchmark row is skipped: the first that holds; empty if none."""
    return (
        F.when(F.coalesce(skip, F.lit("")) == "true", F.concat(F.lit("Annotation: "), F.coalesce(annotation, F.lit(""))))
        .when(F.coalesce(target_text, F.lit("")) == "", "target_identifier_missing")
        .when(targets.isNull(), "target_identifier_parse_error")
        .when(~F.coalesce(found, F.lit(False)), "target_document_not_found")
        .otherwise("")
    )


def skip_counts(rows: DataFrame) -> DataFrame:
    """(reason, n) of skipped rows, by reason and count."""
    return rows.where("skipped").groupBy(F.coalesce("reason", F.lit("unspecified")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy("reason", "n")


def query_texts(rows: DataFrame, saved: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(id, query_type, query, source): a known target's saved texts, else the row's own first two columns."""
    known = rows.join(saved.select("id").distinct(), "id", "left_semi")
    texts = known.join(saved, "id").select("id", "query_type", "query", F.lit("saved").alias("source"))
    fresh = rows.join(saved.select("id").distinct(), "id", "left_anti")
    own = fresh.unpivot(["id"], list(columns[:2]), "query_type", "query")
    return texts.unionByName(own.withColumn("source", F.lit("row"))).where("query IS NOT NULL AND query <> ''")


def verified_saved_queries(data: bytes, sha256: str) -> list[tuple[str, str, str]]:
    """(id, query_type, query) of a saved result file whose digest is as recorded; skipped targets are left out."""
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError("the saved result file is not the recorded one")
    out = []
    for target, entry in json.loads(data).items():
        if target != "summary" and not entry.get("metadata", {}).get("skipped"):
            for kind, q in entry.get("queries", {}).items():
                if not str(q.get("query") or "").strip():
                    raise ValueError(f"no text: {target} / {kind}")
                out.append((target, kind, q["query"]))
    return out


def matched_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries of both runs ``(target, query_type, query, label, <metrics>)`` with ``same_query`` and ``same_label``.

    A label counts as changed only if both runs know it.
    """
    b, a = before.alias("b"), after.alias("a")
    on = (F.col("b.target") == F.col("a.target")) & (F.col("b.query_type") == F.col("a.query_type"))
    return b.join(a, on).select(
        F.col("a.target"), F.col("a.query_type"),
        F.col("b.query").eqNullSafe(F.col("a.query")).alias("same_query"),
        (F.col("b.label").isNull() | F.col("a.label").isNull() | (F.col("b.label") == F.col("a.label"))).alias("same_label"),
        *(F.coalesce(F.col(f"{side}.{m}").cast("double"), F.lit(0.0)).alias(f"{name}_{m}") for m in METRICS[:3] for side, name in (("b", "previous"), ("a", "current"))),
    )


def only_in(one: DataFrame, other: DataFrame) -> DataFrame:
    """Keys of ``one`` that ``other`` lacks, sorted."""
    return one.join(other, ["target", "query_type"], "left_anti").select("target", "query_type").orderBy("target", "query_type")


def comparison_means(matched: DataFrame) -> DataFrame:
    """(query_type, metric, n, previous, current, delta) for all matched queries and each type."""
    same = matched.where("same_query AND same_label")
    parts = [same.select("query_type", F.lit(m).alias("metric"), F.col(f"previous_{m}").alias("previous"), F.col(f"current_{m}").alias("current")) for m in METRICS[:3]]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    means = rows.groupingSets([["query_type", "metric"], ["metric"]], "query_type", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("previous").alias("previous"), F.avg("current").alias("current"))
    return means.withColumn("query_type", F.coalesce("query_type", F.lit("All queries"))).withColumn("delta", F.col("current") - F.col("previous"))


def changes(matched: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(regressions, improvements) of the reciprocal rank: worst first by (delta, key), best first in the reverse of that order."""
    same = matched.where("same_query AND same_label").withColumn("delta", F.col("current_reciprocal_rank") - F.col("previous_reciprocal_rank")).select("target", "query_type", "delta")
    return same.where("delta < 0").orderBy("delta", "target", "query_type").limit(n), same.where("delta > 0").orderBy(F.desc("delta"), F.desc("target"), F.desc("query_type")).limit(n)
