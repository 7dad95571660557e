"""Checks of ingested data. Each returns a small DataFrame or raises on the driver."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..functions.arrow import adler32
from ..functions.constants import DRIFT

REQUIRED = ("src", "llm_description", "embedding_input")


def record_faults(records: DataFrame, kind: str | None = None) -> DataFrame:
    """One row of counts: rows, empty or null ids, repeated ids, missing required fields, wrong kinds."""
    ids = records.groupBy("id").agg(F.count(F.lit(1)).alias("m")).agg(F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m") - 1)), F.lit(0)).alias("repeated_ids"))
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in REQUIRED if c in records.columns]
    wrong = [F.count_if(~F.col("kind").eqNullSafe(F.lit(kind))).alias("wrong_kind")] if kind is not None else []
    counts = records.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("id").cast("string"), F.lit("")) == "").alias("empty_ids"), *missing, *wrong)
    return counts.join(F.broadcast(ids))


def checksum_faults(records: DataFrame) -> DataFrame:
    """Records whose Adler-32 isn't that of their source."""
    return records.withColumn("_sum", adler32("src")).where(~F.col("checksum").eqNullSafe(F.col("_sum"))).drop("_sum")


def vector_faults(vectors: DataFrame, dimension: int, metric: str = "cosine") -> DataFrame:
    return vectors.where(~V.valid(F.col("vector"), dimension, metric))


def count_faults(records: DataFrame, vectors: DataFrame, count: int) -> list[str]:
    out = []
    for name, df in (("records", records), ("vectors", vectors)):
        if (n := df.count()) != count:
            out.append(f"{n} {name} instead of {count}")
    return out


def guard_pruning(previous: DataFrame, current: DataFrame, allow: bool = False) -> tuple[int, int]:
    """(vanished, previous) identities; raises if more than half vanished, unless allowed. Both are ``(id, file, entity_kname)``."""
    key = T.identity(F.col("id"), F.col("file"), F.col("entity_kname")).alias("identity")
    old, new = previous.select(key).distinct(), current.select(key).distinct()
    n, gone = old.count(), old.join(new, "identity", "left_anti").count()
    if gone > n // 2 and not allow:
        raise ValueError(f"{gone} of {n} documents would vanish")
    return gone, n


def zipped(references: DataFrame, inputs: str = "inputs", vectors: str = "vectors", keep: tuple[str, ...] = ()) -> DataFrame:
    """(the columns ``keep``, ord, input, vector): input i goes with vector i; lists of different lengths raise when they are read."""
    same = F.when(F.size(inputs) == F.size(vectors), F.arrays_zip(F.col(inputs).alias("input"), F.col(vectors).alias("vector")))
    pairs = F.coalesce(same, F.raise_error(F.lit("inputs and vectors differ in number")).cast("array<struct<input:string,vector:array<double>>>"))
    return references.select(*keep, F.posexplode(pairs).alias("ord", "pair")).select(*keep, "ord", "pair.input", "pair.vector")


def embedding_drift(vectors: DataFrame) -> DataFrame:
    """One row: the largest relative squared error of ``vectors(actual, expected)``, and whether it is within tolerance."""
    worst = F.max(V.relative_squared_error(F.col("actual"), F.col("expected")))
    return vectors.agg(worst.alias("drift"), (F.coalesce(worst, F.lit(0.0)) <= DRIFT).alias("ok"))


def same_space(specs: DataFrame) -> bool:
    """Whether all corpora share dimension, metric, model, prompt and limit, as a search over several kinds needs."""
    return specs.select("dimension", "metric", "model", "embed_prompt", "max_characters").distinct().count() <= 1


def check_spec(spec: dict) -> None:
    recipe = spec.get("recipe") or {}
    if not (isinstance(spec.get("count"), int) and spec["count"] > 0 and isinstance(spec.get("dimension"), int) and spec["dimension"] > 0):
        raise ValueError("count and dimension are positive whole numbers")
    if spec.get("metric") not in V.METRICS:
        raise ValueError(f"unknown metric: {spec.get('metric')}")
    if not recipe.get("model") or not (recipe.get("prompts") or {}).get("embed") or not isinstance(recipe.get("add_metadata"), bool):
        raise ValueError("the recipe lacks model, embed prompt or add_metadata")


def check_manifest(manifest: dict, forms: tuple[str, ...], version: int) -> None:
    if manifest.get("format") not in forms or manifest.get("version") != version:
        raise ValueError("unknown format or version")
    kinds = [c.get("kind") for c in manifest.get("corpora") or []]
    if not kinds or len(set(kinds)) != len(kinds):
        raise ValueError("corpora have to be of distinct kinds, and some")
    for c in manifest["corpora"]:
        check_spec(c)


def safe_name(name: str) -> bool:
    return re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name) is not None and ".." not in name


def is_safe_path(path: Column) -> Column:
    """:func:`safe_path` of a column: one pattern, so it stays in the plan."""
    return F.coalesce(path.rlike(r"\A(?!\.{1,2}(?:/|\z))[^$~\\\x00/]+(?:/(?!\.{1,2}(?:/|\z))[^$~\\\x00/]+)*\z"), F.lit(False))


def safe_path(path: str) -> bool:
    """A relative path of plain elements."""
    return bool(path) and not re.search(r"^/|//|[$~\\\0]|/$", path) and all(p not in ("", ".", "..") for p in path.split("/"))


def valid_vector(v: list[float], dimension: int, metric: str = "cosine") -> bool:
    return len(v) == dimension and all(math.isfinite(x) for x in v) and (metric != "cosine" or any(x != 0 for x in v))


def batch_failed(statuses: DataFrame) -> bool:
    """Whether no description of a batch succeeded."""
    n, ok = statuses.agg(F.count(F.lit(1)), F.count_if(F.col("status") != "failed")).first()
    return n > 0 and ok == 0
