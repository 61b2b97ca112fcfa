"""State, timers and ledgers of streams: against batch forms and plain runs, through restarts and replays."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from evidentia.sources.views import Tables
from evidentia.streaming.stateful import first_citations, first_citations_batch, next_step, retried_tasks, state_store, tasks_after
from evidentia.streaming.sweep import FilingSweep

DIR = "/root/testdata/sf0.001"
DAY = datetime.date


@pytest.fixture(scope="module", autouse=True)
def stores(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drain(df, out, checkpoint):
    """Run a stream until a batch finds no more data; its batches' rows go to numbered folders."""

    def put(batch, number):
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{out}/{number}")

    q = df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(checkpoint)).trigger(processingTime="100 milliseconds").start()
    until = time.time() + 60
    while not ((p := q.lastProgress) and p["numInputRows"] == 0) and time.time() < until and q.isActive:
        time.sleep(0.1)
    q.stop()
    assert time.time() < until and q.exception() is None


def test_first_citations_once_through_restarts(spark, tmp_path):
    reports = Tables(spark, DIR).reports().select("output_id", (F.col("output_id") % 5).alias("coverage_id"), F.regexp_replace("content", r"filing \d+", "filing").alias("content"))
    reports = reports.withColumn("content", F.regexp_replace("content", r"\[doc_\d+", "[doc_1")).cache()
    feed, schema = str(tmp_path / "feed"), reports.schema
    out = str(tmp_path / "out")

    def stream(ttl):
        return first_citations(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed), "coverage_id", "output_id", "content", ttl)

    for part, cond in enumerate(("output_id < 60", "output_id >= 60 and output_id < 130", "output_id >= 130")):  # each time a new query on the old checkpoint
        reports.filter(cond).coalesce(1).write.mode("append").parquet(feed)
        drain(stream(3_600_000), out, tmp_path / "cp")
    got = [tuple(r) for r in spark.read.parquet(f"{out}/*").select("group", "doc", "section", "quote", "first").collect()]
    want = {tuple(r) for r in first_citations_batch(reports, "coverage_id", "output_id", "content").select("group", "doc", "section", "quote", "first").collect()}
    assert len(want) >= 20 and len(got) == len(set(got)) and set(got) == want
    reports.unpersist()


def plain_tasks(attempts):
    state = {}
    for task, attempt, verdict, cover in sorted(attempts, key=lambda a: (a[0], a[1])):
        status, retries = state.get(task, ("new", 0))
        if status not in ("complete", "partial", "failed"):
            state[task] = next_step(verdict, cover, retries)
    return state


def some_attempts(seed=3, tasks=40):
    r = random.Random(seed)
    out = []
    for task in range(tasks):
        for attempt in range(1, r.randint(1, 6) + 1):
            verdict = r.choice(["approved", "partial", "failed", "failed", None])
            out.append((task, attempt, verdict, None if verdict is None else {"approved": 1.0, "partial": 0.85, "failed": 0.2}[verdict]))
    return out


def test_retries_equal_a_plain_run(spark, tmp_path):
    attempts, schema = some_attempts(), "task_id long, attempt long, verdict string, cover double"
    want = plain_tasks(attempts)
    assert {s for s, _ in want.values()} == {"complete", "waiting", "partial", "failed"}
    assert {r.task_id: (r.status, r.retry_count) for r in tasks_after(spark.createDataFrame(attempts, schema)).collect()} == want
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for k in range(3):  # rows of earlier files come again in later ones
        spark.createDataFrame([a for a in attempts if a[1] <= 2 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(feed)
        drain(retried_tasks(spark.readStream.schema(schema).parquet(feed), delay_ms=3_600_000), out, tmp_path / "cp")
    last = {}
    for number in sorted(int(p.name) for p in (tmp_path / "out").iterdir()):
        last |= {r.task_id: (r.status, r.retry_count) for r in spark.read.parquet(f"{out}/{number}").collect()}
    assert last == want


def test_a_timer_asks_for_the_next_attempt(spark, tmp_path):
    schema = "task_id long, attempt long, verdict string, cover double"
    feed, seen = str(tmp_path / "feed"), []
    spark.createDataFrame([(1, 1, "failed", 0.1), (2, 1, "approved", 1.0)], schema).coalesce(1).write.parquet(feed)
    q = retried_tasks(spark.readStream.schema(schema).parquet(feed), delay_ms=500).writeStream.outputMode("update")
    q = q.foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
    until = time.time() + 60
    while (1, 2, "retry", 1) not in seen and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert sorted(seen) == [(1, 1, "waiting", 1), (1, 2, "retry", 1), (2, 1, "complete", 0)]


def listing(spark, rows):
    return spark.createDataFrame([(i, c, f, DAY.fromisoformat(d) if d else None) for i, c, f, d in rows], "document_id long, coverage_id long, filing_type string, filed_date date")


def test_sweep_adds_one_filing_a_day_and_survives_a_kill(spark, tmp_path):
    s = FilingSweep(spark, f"file://{tmp_path}/sweep", 4)
    listing(spark, [(1, 1, "10-K", "2024-01-05"), (2, 1, "10-Q", "2024-01-02"), (3, 1, "8-K", "2024-02-01"), (4, 2, "10-K", None), (5, 3, "10-K", "2020-01-01"), (6, 3, "10-Q", "2024-03-01")]).coalesce(1).write.parquet(s.feed)
    since = DAY(2023, 1, 1)

    def die(number):
        raise RuntimeError("killed")

    with pytest.raises(Exception):
        s.drain(after_write=die)
    written = s.listings.version
    assert s.listings.read().count() == 6 and written == 1
    assert s.run(DAY(2024, 5, 1), since)  # the batch is replayed and writes nothing
    assert s.listings.version == written
    rows = lambda: sorted(tuple(r) for r in s.documents.read().select("document_id", "status", "swept_on").collect())
    first = [(2, "pending", DAY(2024, 5, 1)), (4, "failed", DAY(2024, 5, 1)), (6, "pending", DAY(2024, 5, 1))]
    assert rows() == first
    assert not s.run(DAY(2024, 5, 1), since) and rows() == first  # the day again
    listing(spark, [(7, 2, "10-Q", "2024-04-01")]).coalesce(1).write.mode("append").parquet(s.feed)
    assert FilingSweep(spark, s.path).run(DAY(2024, 5, 2), since)
    assert rows() == first[:0] + sorted([*first, (1, "pending", DAY(2024, 5, 2)), (7, "pending", DAY(2024, 5, 2))])
