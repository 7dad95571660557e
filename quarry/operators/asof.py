"""As-of match: for each row the last row of another table at or before it, by key, without a join of the two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that the order is cut into, at most; a key's rows of one piece are one window.
BLOCKS = 256
#: Rows of a piece that are aimed at.
BLOCK_ROWS = 1_000_000


def last_before(rows: DataFrame, marks: DataFrame, by: str, at: str, carry: list[str], blocks: int | None = None) -> DataFrame:
    """``rows`` with the columns ``carry`` of the last of ``marks(by, at, carry...)`` that has the same ``by`` and no larger ``at``; nulls if there is none.

    Both tables stand in one order, in which a window carries the last mark along. The order of all rows is cut into pieces at approximate
    quantiles of ``at``, so that a key with most of the rows is many windows; the last mark before a piece enters it as a row of its own, of
    which there is one a key and piece. Of marks at one place the one with the largest ``carry`` counts. A null ``by`` or ``at`` matches nothing;
    other columns of ``rows`` stay, whatever their names.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    left = rows.select(kept.alias("row"), F.col(by).alias("by"), F.col(at).alias("at"))
    right = marks.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("by"), F.col(at).alias("at"), F.struct(*carry).alias("mark"))
    matched = left.where("by IS NOT NULL AND at IS NOT NULL")
    if blocks is None:
        blocks = max(1, min(BLOCKS, -(-(matched.count() + right.count()) // BLOCK_ROWS)))
    places = matched.select("at").unionByName(right.select("at"))
    bounds = sorted(set(places.stat.approxQuantile("at", [i / blocks for i in range(1, blocks)], 0.001))) if blocks > 1 else []
    block = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("at"))) if bounds else F.lit(0)
    none = F.lit(None)
    both = right.withColumn("row", none.cast(left.schema["row"].dataType)).unionByName(matched.withColumn("mark", none.cast(right.schema["mark"].dataType))).withColumn("block", block)
    # the last mark of each piece, and from these the last before it
    ends = both.groupBy("by", "block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct("at", "mark"))).alias("end"))
    before = Window.partitionBy("by").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.select("by", "block", F.last("end", ignorenulls=True).over(before).alias("mark")).where("mark IS NOT NULL")
    rest = both.select("by", "block", "at", "mark", "row").unionByName(entering.select("by", "block", none.cast(both.schema["at"].dataType).alias("at"), "mark", none.cast(both.schema["row"].dataType).alias("row")))
    order = Window.partitionBy("by", "block").orderBy(F.col("at").asc_nulls_first(), F.col("row").isNotNull(), "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rest.withColumn("mark", F.last("mark", ignorenulls=True).over(order)).where("row IS NOT NULL").select("row", "mark")
    unmatched = left.where("by IS NULL OR at IS NULL").select("row", none.cast(right.schema["mark"].dataType).alias("mark"))
    return found.unionByName(unmatched).select(*(F.col("row")[c].alias(c) for c in rows.columns), *(F.col("mark")[c].alias(c) for c in carry))
