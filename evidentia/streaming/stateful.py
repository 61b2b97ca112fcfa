"""Keyed state on streams: first-seen citations, and tasks that are tried again on a timer.

Both run on transformWithStateInPandas, so the query needs the RocksDB state store (``state_store``).
The rules are plain functions; the batch forms and the streams share them. With a time to live or timers a stream runs batches
without data too, so it needs a trigger that goes on (Trigger.AvailableNow would never end).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.citation import CITATION, PARTIAL_FROM

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELLS = 64  # state keys that a group's citations are spread over
MAX_RETRIES, RETRY_DELAY_MS = 3, 30_000
DAY_MS = 86_400_000


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def citation_rows(events: DataFrame, group: str, seq: str, text: str) -> DataFrame:
    """(group, seq, doc, section, quote): a row per citation of each text."""
    part = lambda g: F.regexp_extract_all(text, F.lit(CITATION), F.lit(g))
    found = F.arrays_zip(part(1).alias("doc"), part(2).alias("section"), part(3).alias("quote"))
    return events.select(F.col(group).alias("group"), F.col(seq).alias("seq"), F.explode(found).alias("c")).select("group", "seq", "c.*")


class FirstSeen(StatefulProcessor):
    """What a cell has announced: (doc, section, quote) to the first place, forgotten after the time to live."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "doc string, section string, quote string", "seq long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["doc", "section", "quote"]
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable").drop_duplicates(columns)
        new = [not self.seen.containsKey(k) for k in batch[columns].itertuples(index=False, name=None)]
        batch = batch[new]
        for *k, seq in batch[[*columns, "seq"]].itertuples(index=False, name=None):
            self.seen.updateValue(tuple(k), (int(seq),))
        if len(batch):
            yield batch[["group", *columns, "seq"]].rename(columns={"seq": "first"})

    def close(self) -> None:
        pass


def first_citations(stream: DataFrame, group: str, seq: str, text: str, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """Streaming texts to (group, doc, section, quote, first): each citation of a group once, where it is first seen.

    A group's citations are spread over cells by their hash, so one busy group is many state keys.
    Equal citations are in one cell. ``ttl_ms`` after it was announced a citation is forgotten and would be announced again; None keeps all.
    """
    rows = citation_rows(stream, group, seq, text).withColumn("cell", F.pmod(F.xxhash64("doc", "section", "quote"), F.lit(CELLS)))
    kind = rows.schema["group"].dataType.simpleString()
    return rows.groupBy("group", "cell").transformWithStateInPandas(FirstSeen(ttl_ms), f"group {kind}, doc string, section string, quote string, first long", "Update", "None" if ttl_ms is None else "ProcessingTime")


def first_citations_batch(texts: DataFrame, group: str, seq: str, text: str) -> DataFrame:
    """The same rows from a table: partial minima, no state."""
    return citation_rows(texts, group, seq, text).groupBy("group", "doc", "section", "quote").agg(F.min("seq").alias("first"))


def next_step(verdict: str | None, cover: float | None, retries: int) -> tuple[str, int]:
    """(status, retries) after an attempt: an approved one completes the task, others are tried again until
    MAX_RETRIES; then a well cited answer is partial, any other one failed. A verdict of None is an attempt that raised."""
    if verdict == "approved":
        return "complete", retries
    if retries < MAX_RETRIES:
        return "waiting", retries + 1
    return ("partial" if verdict is not None and (cover or 0.0) >= PARTIAL_FROM else "failed"), retries


class Retries(StatefulProcessor):
    """A task's attempts, in order; a rejected one sets a timer, which asks for the next attempt when it is due."""

    def __init__(self, delay_ms: int, ttl_ms: int):
        self.delay_ms, self.ttl_ms = delay_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "status string, retries int, attempt long", self.ttl_ms)

    def _row(self, key, attempt: int, status: str, retries: int) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [key[0]], "attempt": [attempt], "status": [status], "retry_count": [retries]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, retries, attempt = self.state.get() if self.state.exists() else ("new", 0, 0)
        moved = False
        for row in pd.concat(list(rows)).sort_values("attempt").itertuples(index=False):
            if status in ("complete", "partial", "failed") or row.attempt <= attempt:
                continue  # after the end, or an attempt that was told before
            verdict = None if pd.isna(row.verdict) else row.verdict
            status, retries = next_step(verdict, None if pd.isna(row.cover) else float(row.cover), retries)
            attempt, moved = int(row.attempt), True
        if moved:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if status == "waiting":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay_ms)
            self.state.update((status, retries, attempt))
            yield self._row(key, attempt, status, retries)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            status, retries, attempt = self.state.get()
            if status == "waiting":
                yield self._row(key, attempt + 1, "retry", retries)

    def close(self) -> None:
        pass


def retried_tasks(attempts: DataFrame, delay_ms: int = RETRY_DELAY_MS, ttl_ms: int = 7 * DAY_MS) -> DataFrame:
    """Streaming (task_id, attempt from 1, verdict, cover) to (task_id, attempt, status, retry_count).

    A row per change: complete, waiting, partial or failed, and, ``delay_ms`` after a rejection, retry with the number of the attempt
    that is due. Attempts that come twice or after the end change nothing.
    """
    kind = attempts.schema["task_id"].dataType.simpleString()
    rows = attempts.select("task_id", F.col("attempt").cast("long").alias("attempt"), "verdict", F.col("cover").cast("double").alias("cover"))
    return rows.groupBy("task_id").transformWithStateInPandas(Retries(delay_ms, ttl_ms), f"task_id {kind}, attempt long, status string, retry_count int", "Update", "ProcessingTime")


def tasks_after(attempts: DataFrame) -> DataFrame:
    """Batch form: each task's status and retry_count after all its attempts (numbered from 1 without gaps)."""
    last = MAX_RETRIES + 1
    ok: Column = F.min(F.when((F.col("verdict") == "approved") & (F.col("attempt") <= last), F.col("attempt")))
    rows = attempts.groupBy("task_id").agg(ok.alias("ok"), F.max("attempt").alias("n"), F.max(F.when((F.col("attempt") == last) & F.col("verdict").isNotNull(), F.col("cover"))).alias("cover"))
    status = F.when(F.col("ok").isNotNull(), "complete").when(F.col("n") < last, "waiting").when(F.col("cover") >= PARTIAL_FROM, "partial").otherwise("failed")
    return rows.select("task_id", status.alias("status"), F.coalesce(F.col("ok") - 1, F.least("n", F.lit(MAX_RETRIES))).cast("int").alias("retry_count"))
