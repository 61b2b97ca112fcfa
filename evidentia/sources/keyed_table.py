"""A table that upserts and deletes write: Parquet in hash buckets, copied where touched, with a manifest per version.

Rows lie in ``version/bucket=k`` folders by the hash of their key columns. A write
reads only the buckets that its rows or its condition touch, writes their new
content to a folder of its own and ends by adding a manifest, which says for each bucket
in which version it lies. The manifest is made by an exclusive rename: until then
readers see the version before, a failed write leaves only files that no manifest names, and
of two writers at a time the later one starts again on what the first left.

A write can carry a transaction (a stream's name and its batch number). The manifest keeps
the last number of each name, so a batch that is replayed writes nothing.

The driver holds the bucket numbers, never rows. Each bucket is written by one task;
their number is fixed when the table is made (about a bucket per 128 MB of its final size).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .shared import Folder

BUCKET = "_bucket"
TRIES = 5


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        m = self._manifest()
        self.keys, self.buckets, self.schema = m["keys"], m["buckets"], StructType.fromJson(m["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = 16) -> KeyedTable:
        kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if BUCKET in kind.names:
            raise ValueError(f"{BUCKET} is the table's own column")
        Folder(spark, path).write_new(f"manifests/{0:012d}.json", json.dumps({"version": 0, "keys": keys, "buckets": buckets, "schema": kind.jsonValue(), "at": {}, "seen": {}}))
        return cls(spark, path)

    def _manifest(self) -> dict:
        names = [n for n in self.folder.names("manifests") if n.endswith(".json") and not n.startswith(".")]
        if not names:
            raise FileNotFoundError(f"no table at {self.path}")
        return json.loads(self.folder.read(f"manifests/{names[-1]}"))

    @property
    def version(self) -> int:
        return self._manifest()["version"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, m: dict, only: list[int] | None = None) -> DataFrame:
        at = {int(k): v for k, v in m["at"].items() if only is None or int(k) in only}
        paths = [f"{self.path}/{v}/{BUCKET}={k}" for k, v in sorted(at.items())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The rows of the latest version; later writes don't change what this DataFrame reads."""
        return self._read(self._manifest())

    def _shape(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])

    def _commit(self, change: Callable[[dict], tuple[list[int], DataFrame] | None], txn: tuple[str, int] | None) -> bool:
        """change: from a manifest to the touched buckets and their whole new content."""
        for _ in range(TRIES):
            m = self._manifest()
            if txn and m["seen"].get(txn[0], -1) >= txn[1]:
                return False
            found = change(m)
            new = m | {"version": m["version"] + 1, "at": dict(m["at"]), "seen": m["seen"] | ({txn[0]: txn[1]} if txn else {})}
            if found:
                touched, rows = found
                name = f"v{new['version']:012d}-{self.spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()[:8]}"
                rows = rows.withColumn(BUCKET, self._bucket())
                rows.repartitionById(self.buckets, F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
                there = {int(x.partition("=")[2]) for x in self.folder.names(name) if x.startswith(f"{BUCKET}=")}
                if not there <= set(touched):
                    raise RuntimeError("a write left its buckets")
                new["at"] = {k: v for k, v in new["at"].items() if int(k) not in touched} | {str(k): name for k in there}
            elif not txn:
                return False
            try:
                self.folder.write_new(f"manifests/{new['version']:012d}.json", json.dumps(new))
                return True
            except FileExistsError:
                continue
        raise RuntimeError("other writers came first each time")

    def rewrite(self, updates: DataFrame, resolve: Callable[[DataFrame, DataFrame], DataFrame], txn: tuple[str, int] | None = None) -> bool:
        """resolve(the touched buckets' rows, the updates) gives these buckets' new rows. False if the transaction was seen before."""
        updates = self._shape(updates)

        def change(m: dict):
            touched = [r[0] for r in updates.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
            return (touched, self._shape(resolve(self._read(m, touched), updates))) if touched else None

        return self._commit(change, txn)

    def upsert(self, updates: DataFrame, *order: Column, txn: tuple[str, int] | None = None) -> bool:
        """Insert, or update on equal keys: of the updates the first by ``order`` wins, over any row that is there. Null keys are equal."""
        from ..operators.frames import first_per

        def resolve(current: DataFrame, new: DataFrame) -> DataFrame:
            both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            return first_per(both, self.keys, F.desc("_new"), *order)

        return self.rewrite(updates, resolve, txn)

    def delete(self, condition: Column, txn: tuple[str, int] | None = None) -> bool:
        """Rows for which the condition holds go; buckets without such rows keep their files."""

        def change(m: dict):
            touched = [r[0] for r in self._read(m).filter(condition).select(self._bucket()).distinct().collect()]
            return (touched, self._read(m, touched).filter(~F.coalesce(condition, F.lit(False)))) if touched else None

        return self._commit(change, txn)

    def files(self) -> set[str]:
        """Folders that the latest version reads."""
        return {f"{v}/{BUCKET}={k}" for k, v in self._manifest()["at"].items()}

    def vacuum(self, keep: int = 1) -> None:
        """Drop the files that none of the last ``keep`` versions reads, and older manifests. No write may be under way."""
        names = [n for n in self.folder.names("manifests") if n.endswith(".json")]
        live = [json.loads(self.folder.read(f"manifests/{n}"))["at"] for n in names[-keep:]]
        used = {f"{v}/{BUCKET}={k}" for at in live for k, v in at.items()}
        for version in self.folder.names():
            if version.startswith("v"):
                there = [f"{version}/{x}" for x in self.folder.names(version) if x.startswith(BUCKET)]
                for old in [x for x in there if x not in used] if any(x in used for x in there) else [version]:
                    self.folder.delete(old)
        for n in names[:-keep]:
            self.folder.delete(f"manifests/{n}")


def restate(current: DataFrame, new: DataFrame, keys: list[str], order: list[str], value: str = "value", tolerance: float = 1e-6, parts: int | None = None) -> DataFrame:
    """For KeyedTable.rewrite: observations of a series, kept where they differ from the one kept or seen before.

    A first observation is inserted, an equal one (within ``tolerance``) changes nothing, another one is
    inserted as restated, with its predecessor's value. Rows that are there keep what they say. With ``parts`` the series are
    dealt out in so many parts, as a table whose buckets follow its size has them.
    """
    from pyspark.sql import Window

    both = current.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    both = both.repartition(parts, *keys) if parts else both
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("_new", *order))
    rows = both.withColumn("_before", before).filter(~F.col("_new") | F.col("_before").isNull() | (F.abs(F.col(value) - F.col("_before")) >= tolerance))
    return rows.withColumn("is_restated", F.when(F.col("_new"), F.col("_before").isNotNull()).otherwise(F.col("is_restated"))).withColumn("prior_value", F.when(F.col("_new"), F.col("_before")).otherwise(F.col("prior_value")))
