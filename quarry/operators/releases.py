"""Published artefacts, the revisions that they cover, and the choice among them; small tables throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .asof import last_before


def usable(releases: DataFrame, assets: DataFrame) -> DataFrame:
    """Releases ``(tag, draft, prerelease, published, revision)`` that are final, well tagged and have checksums among their ``assets(tag, name, size)``; newest first, with their size."""
    files = assets.groupBy("tag").agg(F.bool_or(F.col("name").startswith("SHA256")).alias("summed"), F.sum("size").alias("size"))
    base, _ = T.release_tag(F.col("tag"), "[a-z]*")
    return releases.where(~F.col("draft") & ~F.col("prerelease") & base.isNotNull()).join(files.where("summed"), "tag").orderBy(F.desc("published"))


def covered(releases: DataFrame, listed: DataFrame) -> DataFrame:
    """(revision, tag, distance): each release's own revision at distance 0, then those ``listed(revision, tag, distance)`` for it."""
    return releases.select("revision", "tag", F.lit(0).alias("distance")).unionByName(listed.join(releases.select("tag"), "tag", "left_semi").select("revision", "tag", F.coalesce("distance", F.lit(0)).alias("distance")))


def choose(cover: DataFrame, revision: Column) -> DataFrame:
    """Rows whose revision is the same, by prefix either way."""
    return cover.where(T.same_revision(F.col("revision"), revision))


def newest_ancestor(cover: DataFrame, ancestors: DataFrame) -> DataFrame:
    """One row: the covered revision with the largest local number among ``ancestors(node, number)``, matched on 12 characters; the newest release (``published``) of equals."""
    found = cover.withColumn("node", F.substring("revision", 1, 12)).join(ancestors, "node")
    return found.agg(F.max_by(F.struct("revision", "tag", "distance", "number"), F.struct("number", "published")).alias("c")).where("c IS NOT NULL").select("c.*")


def changeset_counts(after: DataFrame, missing: DataFrame | None, paths: DataFrame) -> DataFrame:
    """One row of a checkout's state: published, local, changed.

    ``after(id, phase)`` are the changesets beyond the covered one; local are those that ``missing(id)`` has, or, without
    it, the non-public ones. ``changed`` are the entries of ``paths(path)``, distinct and sorted.
    """
    if missing is None:
        counts = after.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phase") != "public").alias("local"))
    else:
        counts = after.join(missing.withColumn("lacks", F.lit(1)), "id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("lacks").alias("local"))
    changed = changed_entries(paths).agg(F.array_sort(F.collect_list("entry")).alias("changed"))  # a row an entry
    return counts.join(F.broadcast(changed)).select((F.col("n") - F.col("local")).alias("published"), "local", "changed")


def extend_cover(changesets: DataFrame, known: DataFrame) -> DataFrame:
    """(revision, tag, distance): new ``changesets(id, number, fingerprint)`` go to the release with equal sources; the distance counts the changesets since it.

    ``known(tag, number, fingerprint)`` are the releases; of several with equal sources the newest before the changeset counts. Both stand in
    one order, along which the last release is carried, so a fingerprint that most changesets share costs no more than others.
    """
    found = last_before(changesets.select("id", "number", "fingerprint"), known.select("fingerprint", "number", F.col("number").alias("base"), "tag"), "fingerprint", "number", ["base", "tag"])
    return found.where("tag IS NOT NULL").select(F.col("id").alias("revision"), "tag", (F.col("number") - F.col("base")).cast("int").alias("distance"))


def changed_entries(paths: DataFrame) -> DataFrame:
    """(entry): the entries of ``paths(path)``, a row each."""
    return paths.select(T.entry_of_changed_path(F.col("path")).alias("entry")).where("entry IS NOT NULL").distinct()
