"""A keyed store that several builds fill at once: rows in hash buckets, and a log of commits that decides which of them count.

A commit is a small file with the next number, made only if there is none of that number; who loses reads what the
winner added, leaves those keys out and tries the next number. So each key is there once. A commit has a name: the same one
isn't done twice, which makes a repeated batch of a stream harmless. Reads see the commits there were when they began.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..sources.shared import Files

#: Buckets of a new store.
BUCKETS = 64


@dataclass(frozen=True)
class Snapshot:
    """What counts after commit ``number``: the folders of rows, and the names of all commits so far."""

    number: int
    folders: tuple[str, ...]
    names: frozenset[str]


class Store:
    """Rows by ``key`` in a folder of the shared store; the first fill fixes the columns."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.files = spark, Files(spark, folder)
        self._buckets = buckets

    def _log(self) -> list[str]:
        return [n for n in self.files.names("commits") if n.endswith(".json")]

    def snapshot(self) -> Snapshot:
        """By the last commit that lists all folders, and those after it."""
        names = self._log()
        entries, whole = [], 0
        for i in range(len(names) - 1, -1, -1):
            entries.append(json.loads(self.files.read(f"commits/{names[i]}")))
            if "all" in entries[-1]:
                whole = i
                break
        folders: list[str] = []
        seen: set[str] = set()
        for e in reversed(entries):
            folders = list(e["all"]) if "all" in e else folders + e["add"]
            seen |= set(e.get("names", [])) | {e["name"]}
        return Snapshot(int(names[-1].removesuffix(".json")) if names else 0, tuple(folders), frozenset(seen)) if names[whole:] else Snapshot(0, (), frozenset())

    def _form(self) -> dict | None:
        return json.loads(self.files.read("schema.json")) if self.files.exists("schema.json") else None

    @property
    def buckets(self) -> int:
        form = self._form()
        return form["buckets"] if form else self._buckets

    def bucket(self, key: Column | str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, snapshot: Snapshot | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """(key, ..., bucket) of a snapshot; with ``buckets``, no other bucket's files are read. None for a store that was never filled."""
        form, now = self._form(), snapshot or self.snapshot()
        if form is None:
            return None
        schema = StructType.fromJson(form["columns"])
        if not now.folders:
            return self.spark.createDataFrame([], StructType([*schema, StructField("bucket", IntegerType())]))
        full = StructType([*schema, StructField("tx", StringType()), StructField("bucket", IntegerType())])
        rows = self.spark.read.schema(full).option("basePath", f"{self.files.folder}/rows").parquet(*(f"{self.files.folder}/rows/{f}" for f in now.folders)).drop("tx")
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))

    def lookup(self, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame | None:
        """The stored rows of ``keys(key)``, from the buckets that these fall into: at most a number a bucket comes to the driver."""
        wanted = [r[0] for r in keys.select(self.bucket("key").alias("b")).distinct().collect()]
        rows = self.read(snapshot, sorted(wanted))
        return None if rows is None else rows.join(keys.select("key").distinct(), "key", "left_semi").drop("bucket")

    def _write(self, rows: DataFrame) -> str:
        folder = f"tx={uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket("key")).repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{self.files.folder}/rows/{folder}")
        return folder

    def _filled(self, folder: str) -> bool:
        return any(n.startswith("bucket=") for n in self.files.names(f"rows/{folder}"))

    def add(self, rows: DataFrame, name: str | None = None, between: Callable[[], None] = lambda: None) -> bool:
        """Add ``rows(key, ...)`` whose keys aren't there yet; False if a commit called ``name`` was done before.

        Of rows with one key one is kept. ``rows`` are computed once, before the commit; ``between`` runs between both, for tests.
        """
        name = name or uuid.uuid4().hex
        now = self.snapshot()
        if name in now.names:
            return False
        if self._form() is None:
            self.files.create("schema.json", json.dumps({"buckets": self._buckets, "columns": rows.schema.jsonValue()}))
        columns = [f["name"] for f in self._form()["columns"]["fields"]]
        folder = self._write(rows.select(*columns).dropDuplicates(["key"]))
        based: Snapshot | None = None  # the snapshot whose keys were left out of ``folder``
        between()
        while True:
            now = self.snapshot()
            if name in now.names:
                self.files.remove(f"rows/{folder}")
                return False
            if based is None or now.folders != based.folders:
                folder, based = self._without(folder, now, columns), now
            entry = {"name": name, "add": [folder] if self._filled(folder) else []}
            if self.files.create(f"commits/{now.number + 1:020d}.json", json.dumps(entry)):
                return True

    def _without(self, folder: str, now: Snapshot, columns: list[str]) -> str:
        """A folder of the same rows without the keys of a snapshot; the same folder if there are none."""
        if not now.folders or not self._filled(folder):
            return folder
        mine = self.read(Snapshot(0, (folder,), frozenset()))
        held = self.read(now, [int(n.removeprefix("bucket=")) for n in self.files.names(f"rows/{folder}") if n.startswith("bucket=")])
        both = mine.join(held.select("key"), "key", "left_semi")
        if both.isEmpty():
            return folder
        out = self._write(mine.join(held.select("key"), "key", "left_anti").select(*columns))
        self.files.remove(f"rows/{folder}")
        return out

    def compact(self) -> bool:
        """Put all rows into one folder, a file a bucket; what is added meanwhile stays beside it."""
        before = self.snapshot()
        if len(before.folders) < 2:
            return False
        columns = [f["name"] for f in self._form()["columns"]["fields"]]
        folder = self._write(self.read(before).select(*columns))
        while True:
            now = self.snapshot()
            if not set(before.folders) <= set(now.folders):  # another compaction was first
                self.files.remove(f"rows/{folder}")
                return False
            entry = {"name": uuid.uuid4().hex, "all": [folder, *(f for f in now.folders if f not in before.folders)], "names": sorted(now.names)}
            if self.files.create(f"commits/{now.number + 1:020d}.json", json.dumps(entry)):
                return True

    def vacuum(self, seconds: float = 86400.0) -> list[str]:
        """Delete folders of rows that no commit lists and that are older than ``seconds``."""
        kept = set(self.snapshot().folders)
        gone = [n for n in self.files.names("rows") if n not in kept and time.time() - self.files.modified(f"rows/{n}") > seconds]
        for n in gone:
            self.files.remove(f"rows/{n}")
        return gone

    def fill(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], keep: Column | None = None, name: str | None = None) -> None:
        """Compute the rows of ``wanted(key, ...)`` whose keys are missing, once a key, and add those that ``keep`` admits."""
        if name is not None and name in self.snapshot().names:
            return
        distinct = wanted.dropDuplicates(["key"])
        held = self.lookup(distinct)
        missing = distinct if held is None else distinct.join(held.select("key"), "key", "left_anti")
        fresh = compute(missing)
        self.add(fresh if keep is None else fresh.where(keep), name)

    def joined(self, wanted: DataFrame) -> DataFrame:
        """``wanted(key, ...)`` with the stored columns of its keys."""
        return wanted.join(self.lookup(wanted), "key")
