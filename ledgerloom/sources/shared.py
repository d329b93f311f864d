"""Folders that driver and executors share, on any file system Spark can write to."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.errors import StorageError
from ledgerloom.sources.checkpoint import ensure_checkpoint_dir


def fresh(spark: SparkSession, what: str) -> str:
    """Path of a new folder in the checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written once to the checkpoint folder and read from there: lineage ends here."""
    df.write.parquet(path := fresh(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SharedFolder:
    """The few operations a commit needs; data goes through Spark's readers and writers."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = str(root).rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        top = self._path(self.root)
        self._fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        uri = self._fs.makeQualified(top).toUri()
        self._local = uri.getPath() if uri.getScheme() == "file" else None
        self._fs.mkdirs(top)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Create a file whole, unless it is there: false if another writer came first."""
        part = f".{name}.{uuid.uuid4().hex}"
        if self._local is not None:  # a hard link fails if the name is taken
            tmp, target = os.path.join(self._local, part), os.path.join(self._local, name)
            with open(tmp, "x") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(tmp, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(tmp)
        stream = self._fs.create(self._path(self.at(part)), False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if self._fs.rename(self._path(self.at(part)), self._path(self.at(name))):
            return True
        self.remove(part)
        if not self.exists(name):
            raise StorageError(f"cannot publish {self.at(name)}")
        return False

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)
