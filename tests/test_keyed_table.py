"""Tables that upserts write: versions, untouched buckets, failures, replays and races."""

import pytest
from pyspark.sql import functions as F

from evidentia.sources.keyed_table import KeyedTable, restate

SCHEMA = "id long, name string, n int"


def make(spark, tmp_path, buckets=8):
    return KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], buckets)


def rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_two_upserts_a_delete_and_a_failed_one(spark, tmp_path):
    t = make(spark, tmp_path)
    assert rows(t) == [] and t.version == 0
    t.upsert(frame(spark, [(i, f"a{i}", i) for i in range(20)] + [(None, "none", 0), (3, "late", 9)]), F.desc("n"))
    want = {i: (i, f"a{i}", i) for i in range(20)} | {3: (3, "late", 9), None: (None, "none", 0)}
    assert rows(t) == sorted(want.values(), key=str)
    before, seen = t.files(), t.read()
    t.upsert(frame(spark, [(3, "b3", 1), (30, "new", 2), (None, "again", 1)]), F.desc("n"))
    want |= {3: (3, "b3", 1), 30: (30, "new", 2), None: (None, "again", 1)}
    assert rows(t) == sorted(want.values(), key=str)
    assert len(before - t.files()) <= 3 and before & t.files()  # the other buckets keep their files
    assert seen.count() == 21  # a reader keeps its version
    with pytest.raises(Exception):
        t.upsert(frame(spark, [(1, "x", 1)]).withColumn("n", F.raise_error(F.lit("lost"))), F.desc("n"))
    assert t.version == 2 and rows(t) == sorted(want.values(), key=str)
    t.delete(F.col("n") > 10)
    assert rows(t) == sorted((r for r in want.values() if r[2] <= 10), key=str) and t.version == 3
    assert not t.delete(F.col("name") == "nobody") and t.version == 3
    t.vacuum()
    assert rows(KeyedTable(spark, t.path)) == sorted((r for r in want.values() if r[2] <= 10), key=str)
    assert len(t.folder.names("manifests")) == 1


def test_a_replayed_transaction_writes_nothing(spark, tmp_path):
    t = make(spark, tmp_path)
    assert t.upsert(frame(spark, [(1, "a", 1)]), txn=("feed", 0))
    assert not t.upsert(frame(spark, [(1, "b", 1)]), txn=("feed", 0))
    assert t.upsert(frame(spark, []), txn=("feed", 1)) and not t.upsert(frame(spark, [(1, "c", 1)]), txn=("feed", 1))
    assert t.upsert(frame(spark, [(2, "d", 1)]), txn=("other", 0))
    assert rows(t) == [(1, "a", 1), (2, "d", 1)]


def test_a_writer_that_comes_second_starts_again(spark, tmp_path):
    t = make(spark, tmp_path, 2)
    t.upsert(frame(spark, [(i, "a", 0) for i in range(6)]))
    calls = []

    def resolve(current, new):
        if not calls:  # while the first writer works, another one commits
            KeyedTable(spark, t.path).upsert(frame(spark, [(0, "other", 1)]))
        calls.append(1)
        return current.withColumn("n", F.col("n") + 1)

    t.rewrite(frame(spark, [(i, "", 0) for i in range(6)]), resolve)
    assert len(calls) == 2 and rows(t) == [(0, "other", 2)] + [(i, "a", 1) for i in range(1, 6)]


def test_deleted_buckets_and_odd_schemas(spark, tmp_path):
    t = make(spark, tmp_path, 3)
    t.upsert(frame(spark, [(i, "a", i) for i in range(9)]))
    t.delete(F.lit(True))
    assert rows(t) == [] and t.files() == set()
    t.upsert(frame(spark, [(1, None, None)]))
    assert rows(t) == [(1, None, None)]
    with pytest.raises(ValueError):
        KeyedTable.create(spark, f"file://{tmp_path}/u", "_bucket int", ["_bucket"])
    with pytest.raises(FileExistsError):
        KeyedTable.create(spark, t.path, SCHEMA, ["id"])
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, f"file://{tmp_path}/none")


def test_series_in_batches_equal_a_plain_run(spark, tmp_path):
    """Equal values change nothing, others are kept as restated, whatever the batches."""
    import random

    r = random.Random(4)
    data = [(r.choice(["a", "b"]), i, r.choice([1.0, 1.0, 1.0 + 1e-8, 2.0, -3.5])) for i in range(60)]
    kept, last = [], {}
    for k, i, v in data:
        if k not in last or abs(v - last[k]) >= 1e-6:
            kept.append((k, i, v, k in last))
            last[k] = v
    t = KeyedTable.create(spark, f"file://{tmp_path}/s", "k string, i long, value double, is_restated boolean, prior_value double", ["k"], 4)
    for a in range(0, 60, 20):
        df = spark.createDataFrame(data[a : a + 20], "k string, i long, value double").selectExpr("*", "cast(null as boolean) is_restated", "cast(null as double) prior_value")
        t.rewrite(df, lambda current, new: restate(current, new, ["k"], ["i"]), txn=("kpi", a))
    assert sorted((x.k, x.i, x.value, x.is_restated) for x in t.read().collect()) == sorted(kept)
