"""The daily sweep: listed filings come in as files, and each day one new filing per coverage becomes a document.

A sweep drains the feed (Trigger.AvailableNow) into the table of listings and then adds to the table of documents. Both
are KeyedTables whose manifests are the ledger: the feed's batches and the days carry their number,
so a batch that was written but not committed by the stream, or a day that is run twice,
writes nothing the second time.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.frames import first_per
from ..sources.keyed_table import KeyedTable

LISTING = "document_id long, coverage_id long, filing_type string, filed_date date"
DOCUMENT = LISTING + ", status string, error string, swept_on date"
FORMS = ("10-Q", "10-K")


class FilingSweep:
    """Tables, feed and checkpoint of one sweep under a shared folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.feed = f"{self.path}/feed"
        make = lambda name, schema, keys: self._table(f"{self.path}/{name}", schema, keys, buckets)
        self.listings, self.documents = make("listings", LISTING, ["document_id"]), make("documents", DOCUMENT, ["document_id"])

    def _table(self, path: str, schema: str, keys: list[str], buckets: int) -> KeyedTable:
        try:
            return KeyedTable(self.spark, path)
        except FileNotFoundError:
            return KeyedTable.create(self.spark, path, schema, keys, buckets)

    def drain(self, after_write=None) -> None:
        """New files of the feed into the listings. ``after_write`` runs between a batch's write and the stream's commit."""

        def take(batch: DataFrame, number: int) -> None:
            self.listings.upsert(batch, F.desc("filed_date"), txn=("feed", number))
            if after_write:
                after_write(number)

        stream = self.spark.readStream.schema(LISTING).parquet(self.feed)
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def candidates(self, since: datetime.date) -> DataFrame:
        """Per coverage the first listed form that is no document yet: quarterly ones first, then the newest."""
        new = self.listings.read().filter(F.col("filing_type").isin(*FORMS) & (F.coalesce("filed_date", F.lit(since) + F.expr("INTERVAL 1 DAY")) > F.lit(since)))
        new = new.join(self.documents.read().select("document_id"), "document_id", "left_anti")
        return first_per(new, ["coverage_id"], F.when(F.col("filing_type") == "10-Q", 0).otherwise(1), F.desc("filed_date"), F.desc("document_id")).drop("rn")

    def sweep(self, day: datetime.date, since: datetime.date) -> bool:
        """One document per coverage for a day; a filing without a date fails for its coverage alone. False: the day was swept before."""
        error = F.when(F.col("filed_date").isNull(), "no filing date")
        rows = self.candidates(since).select("document_id", "coverage_id", "filing_type", "filed_date", F.when(error.isNull(), "pending").otherwise("failed").alias("status"), error.alias("error"), F.lit(day).alias("swept_on"))
        return self.documents.upsert(rows, F.desc("filed_date"), txn=("day", day.toordinal()))

    def run(self, day: datetime.date, since: datetime.date) -> bool:
        self.drain()
        return self.sweep(day, since)
