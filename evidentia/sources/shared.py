"""Folders that the driver and all executors share, through the file system that Spark reads them by."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="evidentia-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """Small files of a folder, for manifests and ledgers; data goes through Spark's readers and writers."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, inside: str = "") -> list[str]:
        at = self._at(inside)
        if not self.fs.exists(at):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """All of a file or nothing, and only if no other writer made it first: FileExistsError."""
        head, _, tail = name.rpartition("/")
        draft = self._at(f"{head + '/' if head else ''}.{tail}-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(draft, self._at(name), rename)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(self._at(name)):
                raise FileExistsError(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
