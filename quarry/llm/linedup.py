"""Line deduplication by sorted key hashes and per-document bitmaps; DataFrame expressions only.

Lines are hashed once and travel as (128-bit hash of the key, document, position), never as text. The hashes are
range-partitioned with a secondary sort by document and position, and a scan of each range streams a key's first
occurrences: no group is buffered. A key that a third of all lines share is cut by a salt: the salted ranges pass on only its
first ``min_docs`` documents each, and a second range partitioning brings those together. The frequent keys, with their first
occurrence, are joined with the hashes again; a document gets back a compressed bitmap of its lines, 64 lines
a word and words without marks left out. The text is touched once more, to apply the bitmap.

A row is known by its id and the hash of its text, so rows that share an id each keep their own bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

_SPACES = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of frequent keys up to this many rows of 48 bytes is broadcast; a larger one is joined by shuffle.
BROADCAST_KEYS = 500_000
#: Bitmaps are broadcast up to so many words of 64 lines and their rows, of about 100 bytes; more are joined by shuffle.
BROADCAST_WORDS = 400_000
_ROW = ("doc_id", "t1", "t2")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends and with A-Z as a-z."""
    line = F.btrim(line, F.lit(_SPACES))
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _hash(column: Column) -> tuple[Column, Column]:
    return F.xxhash64(column), F.xxhash64(F.lit("second"), column)


def hashed_lines(documents: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2): the row's id and the hash of its text, and each line's position and the hash of its key, if that is long enough."""
    t1, t2 = _hash(F.coalesce("text", F.lit("")))
    lines = documents.select(F.col("doc_id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    h1, h2 = _hash(F.col("key"))
    return lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars).select(*_ROW, "pos", h1.alias("h1"), h2.alias("h2"))


def _without_copies(lines: DataFrame) -> DataFrame:
    """The lines of one row for each text, that with the smallest id."""
    least = written(lines.groupBy("t1", "t2").agg(F.min("doc_id").alias("least")))
    least = F.broadcast(least) if least.count() <= BROADCAST_KEYS else least
    return lines.join(least, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("least"))).drop("least")


def frequent_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, first_doc, first_t1, first_t2, first_pos): keys found under at least ``min_docs`` ids, and where each stands first.

    ``lines`` has the columns of :func:`hashed_lines`, with a key's lines any number of times. Null ids are one document, the first one.
    """
    n = shuffle_partitions(lines.sparkSession)
    order = [*_ROW, "pos"]

    def first_documents(rows: DataFrame, *key: str) -> DataFrame:
        """Of the first ``min_docs`` documents under each key their first row, with its number: a scan of sorted ranges."""
        ranges = rows.repartitionByRange(n, *key).sortWithinPartitions(*key, *order)
        window = Window.partitionBy(*key).orderBy("doc_id")
        ranked = ranges.withColumn("n", F.dense_rank().over(window)).where(F.col("n") <= min_docs)
        at = Window.partitionBy(*key).orderBy(*order)
        return ranked.withColumn("before", F.lag("n", 1, 0).over(at)).where(F.col("before") < F.col("n")).drop("before")

    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    some = written(first_documents(salted, "h1", "h2", "salt").drop("n", "salt"))
    at = Window.partitionBy("h1", "h2").orderBy(*order)
    first = F.first(F.struct(*order)).over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = first_documents(some, "h1", "h2").withColumn("first", first).where(F.col("n") == min_docs)
    return found.select("h1", "h2", *(F.col(f"first.{c}").alias("first_doc" if c == "doc_id" else f"first_{c}") for c in order))


def drop_bitmaps(documents: DataFrame, min_docs: int, min_chars: int = 1, keep: str = "none", copies: str = "apart") -> DataFrame:
    """(doc_id, t1, t2, n_dropped, words): for each row that loses lines, by its id and the hash of its text, the bitmap of these as a map from word number to 64 bits.

    ``keep='none'`` drops every line with a frequent key; ``keep='first'`` leaves the first one, by document and position.
    ``copies='one'`` counts rows with equal texts as one document, that with the smallest id, and treats them all alike.
    """
    lines = written(hashed_lines(documents, min_chars))
    frequent = written(frequent_keys(_without_copies(lines) if copies == "one" else lines, min_docs))
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    hits = lines.join(frequent, ["h1", "h2"])
    if keep == "first":
        place = (F.col("t1") == F.col("first_t1")) & (F.col("t2") == F.col("first_t2")) & (F.col("pos") == F.col("first_pos"))
        hits = hits.where(~(place if copies == "one" else place & F.col("doc_id").eqNullSafe(F.col("first_doc"))))
    words = hits.groupBy(*_ROW, F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return words.groupBy(*_ROW).agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, counts: bool = True) -> DataFrame:
    """``documents`` with ``text`` without the lines that the bitmaps mark, and ``n_lines`` (before) and ``n_dropped`` if ``counts``.

    Columns of ``documents`` with those two names are then replaced; without ``counts`` all stay as they are.
    """
    bitmaps = written(bitmaps)
    size = bitmaps.agg(F.coalesce(F.sum(F.size("words") + 1), F.lit(0)).alias("n")).first()["n"]
    names = [c for c in documents.columns if not (counts and c in ("n_lines", "n_dropped"))]
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    t1, t2 = _hash(F.coalesce("text", F.lit("")))
    marks = bitmaps.select(F.struct(*_ROW).alias("of"), "n_dropped", "words")
    # everything of the documents in one struct: no name can clash
    rows = documents.select(row, F.struct("doc_id", t1.alias("t1"), t2.alias("t2")).alias("own"))
    out = rows.join(F.broadcast(marks) if size <= BROADCAST_WORDS else marks.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("of")), "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    kept = F.filter(_lines(text), lambda _, i: F.getbit(F.coalesce(F.element_at("words", F.shiftright(i, 6)), F.lit(0).cast("long")), i.bitwiseAND(F.lit(63))) == 0)
    fresh = F.when(F.col("words").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    told = [F.size(_lines(text)).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return out.select(*(fresh if c == "text" else F.col("row")[c].alias(c) for c in names), *told)


def dedup_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", copies: str = "apart", counts: bool = True) -> DataFrame:
    """Every row of ``documents(doc_id, text, ...)`` with ``text`` without its repeated lines, ``n_lines`` and ``n_dropped``.

    A line's key is the line without ASCII white space at both ends and with A-Z lowered. Keys of at least ``min_chars``
    code points found under at least ``min_docs`` ids lose their lines: all of them, or all but the first in order of
    ``doc_id``, null first, then of the texts' hashes where rows share an id, then of position (``keep='first'``). With ``copies='one'``, rows with equal texts count as one document and keep or
    lose the same lines. Null and empty texts are one empty line and stay, or become, an empty text. Rows that share an id are one
    document when keys are counted, yet each row loses its own lines and counts them; null ids count as one document. Repeated rows stay
    repeated. Other columns are carried along, whatever their names, except that ``n_lines`` and ``n_dropped`` are replaced if
    ``counts``. A text may be as long as a row can be. The table may be empty.
    """
    plain = documents.select("doc_id", "text")
    return apply_bitmaps(documents, drop_bitmaps(plain, min_docs, min_chars, keep, copies), counts)
