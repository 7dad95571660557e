"""The keyed store: writers at once, repeated commits, buckets, compaction, and streams that start again."""

import threading

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quarry.operators.store import Store
from quarry.streaming.live import incremental_store


def rows(spark, keys, value="v"):
    return spark.createDataFrame([(str(k), value) for k in keys], "key string, value string")


def content(store):
    return sorted((r.key, r.value) for r in store.read().collect())


def test_writers_at_once_leave_each_key_once(spark, tmp_path):
    folder, gate = str(tmp_path / "s"), threading.Barrier(3)

    def write(i):
        Store(spark, folder, 8).add(rows(spark, range(i * 5, i * 5 + 10), f"w{i}"), between=gate.wait)

    some = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in some]
    [t.join() for t in some]
    store = Store(spark, folder)
    assert [k for k, _ in content(store)] == sorted(map(str, range(20))) and store.snapshot().number == 3 and store.buckets == 8


def test_a_commit_of_one_name_is_done_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.add(rows(spark, [1, 2]), "a") and not store.add(rows(spark, [3]), "a")
    assert store.add(rows(spark, [2, 3, 3], "w"), "b")
    assert content(store) == [("1", "v"), ("2", "v"), ("3", "w")]
    assert store.compact() and not store.add(rows(spark, [9]), "b") and len(store.snapshot().folders) == 1


def test_a_name_committed_meanwhile_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not store.add(rows(spark, [1], "late"), "x", between=lambda: Store(spark, str(tmp_path / "s")).add(rows(spark, [1], "first"), "x"))
    assert content(store) == [("1", "first")]


def test_fill_computes_what_is_missing_only(spark, tmp_path):
    store, asked = Store(spark, str(tmp_path / "s")), []

    def compute(missing):
        asked.append(sorted(r.key for r in missing.collect()))
        return missing.select("key", F.concat("key", F.lit("!")).alias("value"))

    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n int")
    store.fill(wanted, compute, F.col("key") != "b")
    store.fill(wanted, compute)
    store.fill(wanted, compute, name="n")
    store.fill(wanted.limit(0), compute, name="n")
    assert asked == [["a", "b"], ["b"], []]
    assert sorted((r.key, r.n, r.value) for r in store.joined(wanted).collect()) == [("a", 1, "a!"), ("a", 2, "a!"), ("b", 3, "b!")]


def test_a_lookup_reads_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 16)
    store.add(rows(spark, range(200)))
    store.add(rows(spark, range(200, 300)))
    found = store.lookup(rows(spark, [7, 250, 999]))
    assert sorted(r.key for r in found.collect()) == ["250", "7"] and found.columns == ["key", "value"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    few = store.read(buckets=[3])
    assert len(few.inputFiles()) >= 1 and {r.bucket for r in few.collect()} == {3}
    assert store.read(buckets=[]).count() == 0


def test_compaction_keeps_what_is_added_meanwhile_and_vacuum_the_rest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    for i in range(3):
        store.add(rows(spark, [i]), f"c{i}")
    old = store.snapshot()
    assert store.compact() and not store.compact()
    store.add(rows(spark, [3]), "later")
    assert [k for k, _ in content(store)] == ["0", "1", "2", "3"] and len(store.snapshot().folders) == 2 and store.snapshot().names >= {"c0", "c1", "c2", "later"}
    assert store.read(old).count() == 3  # an old snapshot is still there
    assert store.vacuum() == [] and sorted(store.vacuum(-1)) == sorted(old.folders) and len(content(store)) == 4


def test_empty_stores_and_fills(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read() is None and store.lookup(rows(spark, [1])) is None and store.snapshot().number == 0
    assert store.add(rows(spark, [])) and content(store) == []
    assert store.lookup(rows(spark, [1])).count() == 0 and not store.compact()
    store.add(rows(spark, [1]).withColumn("other", F.lit(1)))  # columns are those of the first fill
    assert content(store) == [("1", "v")]


def test_a_stream_that_starts_again(spark, tmp_path):
    rows(spark, range(40)).repartition(4).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, calls = Store(spark, str(tmp_path / "s")), []

    def compute(missing):
        calls.append(missing.count())
        return missing.select("key", "value")

    def stop(n):
        if n == 1:
            raise OSError("stopped")

    with pytest.raises(StreamingQueryException, match="stopped"):
        incremental_store(source(), str(tmp_path / "c"), store, compute, "q", after=stop).awaitTermination(120)
    incremental_store(source(), str(tmp_path / "c"), store, compute, "q").awaitTermination(120)
    assert len(content(store)) == 40 and len(calls) == 4 and store.snapshot().number == 4  # the batch that was run again computed nothing
