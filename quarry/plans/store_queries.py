"""Queries through keyed stores and streams, beside SQL over the tables that they are built from."""

from __future__ import annotations

import threading

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators.store import Store
from ..sources.shared import Files, shared_folder
from ..streaming.live import incremental_store
from .catalog import query
from .queries import _table

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _measured(rows):
    return rows.select("key", F.length("text").cast("long").alias("n_chars"), F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("n_words"))


def _keyed(docs):
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS key, length(coalesce(text, ''))::BIGINT AS n_chars, {_WORDS}::BIGINT AS n_words, (SELECT count(DISTINCT coalesce(text, '')) FROM documents) AS stored FROM documents")
def shared_store(spark, sf_dir):
    """Two builds fill one store at once, each with all documents; a third adds nothing. Every text is stored once, and found again after compaction."""
    docs = _keyed(_table(spark, sf_dir, "documents"))
    folder = shared_folder(spark, "store")
    both = threading.Barrier(2)
    failed: list[BaseException] = []

    def build(half):
        store = Store(spark, folder)
        try:
            store.add(_measured(docs.where(half).dropDuplicates(["key"])), between=both.wait)  # both have written before either commits
        except BaseException as e:
            failed.append(e)
            both.abort()

    builds = [threading.Thread(target=build, args=(half,)) for half in (F.col("doc_id") % 3 < 2, F.col("doc_id") % 3 > 0)]
    for b in builds:
        b.start()
    for b in builds:
        b.join()
    if failed:
        raise failed[0]
    store = Store(spark, folder)
    store.fill(docs, _measured)
    store.compact()
    stored = store.read().agg(F.count(F.lit(1)).alias("stored"))
    return store.joined(docs).join(F.broadcast(stored)).select("doc_id", "key", "n_chars", "n_words", "stored")


class _Stopped(Exception):
    """The stop of a stream amid its batches."""


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS key, length(coalesce(text, ''))::BIGINT AS n_chars, {_WORDS}::BIGINT AS n_words, (SELECT count(DISTINCT coalesce(text, '')) FROM documents) AS stored FROM documents")
def restarted_stream(spark, sf_dir):
    """A stream over the documents in six files stops after the commit of its third batch and before it has noted that; started again, it ends as if it hadn't."""
    docs = _table(spark, sf_dir, "documents")
    base = shared_folder(spark, "stream")
    _keyed(docs).repartition(6).write.parquet(f"{base}/in")
    source = lambda: spark.readStream.schema("doc_id long, text string, key string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    store = Store(spark, f"{base}/store")

    def stop(number: int) -> None:
        if number == 2:
            raise _Stopped()

    try:
        incremental_store(source(), f"{base}/checkpoint", store, _measured, "documents", after=stop).awaitTermination()
    except StreamingQueryException as e:
        if "_Stopped" not in str(e):
            raise
    else:
        raise AssertionError("the stream didn't stop")
    done = len(Files(spark, f"{base}/store").names("commits"))
    incremental_store(source(), f"{base}/checkpoint", store, _measured, "documents").awaitTermination()
    assert done == 3 and len(Files(spark, f"{base}/store").names("commits")) == 6
    stored = store.read().agg(F.count(F.lit(1)).alias("stored"))
    return store.joined(_keyed(docs)).join(F.broadcast(stored)).select("doc_id", "key", "n_chars", "n_words", "stored")
