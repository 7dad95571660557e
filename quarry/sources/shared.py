"""The folder that all machines share, and what the driver does with paths there through Hadoop's file systems."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "quarry") -> str:
    """URI of a new folder, not yet made, below the one named in ``spark.checkpoint.dir``; its scheme stays.

    Where that is unset, a temporary folder takes its place for the life of a session on one machine; on any other master ``ValueError`` is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{uri(root).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def uri(path: str) -> str:
    """A path with its scheme; plain ones are files."""
    return path if re.match(r"[a-zA-Z][a-zA-Z0-9+.\-]*:", path) else f"file://{path}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: its lineage ends here."""
    folder = folder or shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Files:
    """What the driver does with single paths, by Hadoop's file systems: any store that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = uri(folder).rstrip("/")
        self.store = self._path("").getFileSystem(self.conf)
        if self.store.getScheme() == "file":
            self.store = self.store.getRaw()  # without hidden checksums beside files that others may edit

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self.store.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """The entries of a folder but hidden ones; none if there is no such folder."""
        found = (s.getPath().getName() for s in self.store.listStatus(self._path(name))) if self.exists(name) else ()
        return sorted(n for n in found if not n.startswith("."))

    def walk(self, name: str = "") -> list[tuple[str, int]]:
        """(path within the folder, bytes) of all files below but hidden ones."""
        out, todo = [], [name]
        while todo:
            at = todo.pop()
            for s in self.store.listStatus(self._path(at)):
                if s.getPath().getName().startswith("."):
                    continue
                inner = f"{at}/{s.getPath().getName()}".lstrip("/")
                if s.isDirectory():
                    todo.append(inner)
                else:
                    out.append((inner, s.getLen()))
        return sorted(out)

    def make(self, name: str = "") -> None:
        self.store.mkdirs(self._path(name))

    def remove(self, name: str = "") -> None:
        self.store.delete(self._path(name), True)

    def move(self, source: str, target: str) -> bool:
        """Whether the rename was done: it isn't where the target exists."""
        return not self.exists(target) and self.store.rename(self._path(source), self._path(target))

    def read(self, name: str) -> str:
        stream = self.store.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new small file; False if there is one already. The writer that makes it has won."""
        try:
            stream = self.store.create(self._path(name), False)
        except Exception as e:
            if "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        stream = self.store.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        """A small file by a new one and a rename over the old: readers see one or the other."""
        temp = f"{name}.{uuid.uuid4().hex}"
        self.replace(temp, text)
        fs = self.jvm.org.apache.hadoop.fs
        kind = getattr(fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        fs.FileContext.getFileContext(self.store.getUri(), self.conf).rename(self._path(temp), self._path(name), options)

    def size(self, name: str) -> int:
        return self.store.getFileStatus(self._path(name)).getLen()

    def modified(self, name: str) -> float:
        """Seconds since the epoch; of a file that has gone, 0."""
        try:
            return self.store.getFileStatus(self._path(name)).getModificationTime() / 1000
        except Exception as e:
            if "FileNotFound" in str(e):
                return 0.0
            raise
