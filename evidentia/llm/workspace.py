"""Shared-folder tables: lineage is cut by writing to the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A fresh folder for one operator call. Tables in it outlive lost executors.

    The folder lies in spark.checkpoint.dir, which all executors share. Only a
    local-mode session without that setting falls back to a temporary folder.
    close() deletes the folder; results that still read it last as long as the
    application, whose end deletes it otherwise.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="evidentia-")
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        root = self._at(self.root)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        fs.deleteOnExit(root)

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, fmt: str = "parquet", **options) -> DataFrame:
        """Write once, read back: later stages start from the files, not from the lineage."""
        df.write.mode("overwrite").format(fmt).options(**options).save(self.path(name))
        return self.load(name, df, fmt)

    def load(self, name: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
        return self.spark.read.format(fmt).schema(like.schema).load(self.path(name))

    def drop(self, name: str) -> None:
        """Free a table that no live DataFrame reads any more."""
        self._delete(self.path(name))

    def close(self) -> None:
        """Free all tables, when no result is read any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self._at(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of stages that nothing refers to any more."""
        self.spark.sparkContext._jvm.System.gc()
