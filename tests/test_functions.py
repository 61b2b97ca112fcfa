"""Golden cases of the scalar functions, chunk invariants, scope guards, and streams against their batch form."""

import math
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.functions.finance import normalize_value, scan_spans
from evidentia.functions.period import normalize_period
from evidentia.operators.chunking import children, parent_texts, windows
from evidentia.operators.retrieval import fuse
from evidentia.scope import TenantScope
from evidentia.streaming.tasks import cut_safe, safe_chunks, safe_pieces, windowed_counts

# Built from the rules: an amount, its sign, currency and scale, and what they mean together.
AMOUNTS = (7.25, 318.0, 0.75)
SCALES = ((" million", 1.0), (" billion", 1000.0), ("B", 1000.0), ("K", 0.001))
MONEY = [(f"{sign}{x:g}{word}", None, x * by, f"{code}_millions", code, False) for x in AMOUNTS for sign, code in (("$", "USD"), ("€", "EUR"), ("£", "GBP")) for word, by in SCALES]
LOSSES = [(text.format(f"{x:g}{word}"), None, x * by, "USD_millions", "USD", True) for x in AMOUNTS for word, by in SCALES for text in ("({})", "$({})", "−{}", "–{}")]
OTHERS = [case for x in AMOUNTS for case in ((f"{x:g}%", None, x, "percentage", None, False), (f"({x:g})%", None, x, "percentage", None, True), (f"{x:g}x", None, x, "ratio", None, False), (f"{x:g}M shares", None, x * 1e6, "count", None, False), (f"${x:g}", "thousands", x / 1000, "USD_millions", "USD", False))]
VALUES = MONEY + LOSSES + OTHERS
YEARS, QUARTERS = (1998, 2031), ("first", "second", "third", "fourth")
PERIODS = [case for y in YEARS for case in ((f"fiscal year {y}", f"FY{y}"), (f"annual {y}", f"FY{y}"), (f"year ended June 30, {y}", f"FY{y}"), (f"three months ended Jun 30, {y}", f"Q2 {y}"), (f"three months ended Sep 30, {y}", f"Q3 {y}"))]
PERIODS += [case for y in YEARS for q, word in enumerate(QUARTERS, 1) for case in ((f"Q{q} {y}", f"Q{q} {y}"), (f"{word} quarter {y}", f"Q{q} {y}"))] + [("no date in here", None), ("", None), (None, None)]


def test_values(spark):
    df = spark.createDataFrame([(v[0], v[1]) for v in VALUES], "raw string, ctx string").coalesce(1)
    got = df.select(normalize_value(F.col("raw"), F.col("ctx")).alias("v")).collect()
    for (raw, _, value, unit, currency, negative), (v,) in zip(VALUES, got):
        assert v.numeric_value == pytest.approx(value), raw
        assert (v.unit, v.currency, v.is_negative) == (unit, currency, negative), raw
        assert v.confidence > 0


def test_unreadable_values_never_fail(spark):
    df = spark.createDataFrame([(x,) for x in ("--", "none", "\t", "", "%%", "two furlongs", "$", None, "40 furlongs")], "raw string")
    for (v,) in df.select(normalize_value(F.col("raw")).alias("v")).collect():
        assert math.isnan(v.numeric_value) and v.confidence == 0 and v.unit == "unknown"


def test_periods(spark):
    df = spark.createDataFrame([(p[0],) for p in PERIODS], "raw string").coalesce(1)
    got = df.select(normalize_period(F.col("raw")).alias("p")).collect()
    assert [(p.label if p else None) for (p,) in got] == [label for _, label in PERIODS]


def test_scan_ignores_bare_numbers(spark):
    df = spark.createDataFrame([("In 1998 it had 31 plants and 7 mills.",), ("Sales of €7.25 million rose 4.5% more.",), (None,)], "t string").coalesce(1)
    a, b, c = [r[0] for r in df.select(scan_spans(F.col("t"))).collect()]
    assert a == [] and [x.match for x in b] == ["€7.25 million", "4.5%"] and not c


def test_windows_cover_all_and_advance():
    tokens = [30, 50, 120, 10, 15, 200, 5, 5, 300, 1]
    spans = list(windows(tokens))
    assert spans[0][0] == 0 and spans[-1][1] == len(tokens)
    assert all(b > a for a, b in spans) and all(x[0] < y[0] <= x[1] for x, y in zip(spans, spans[1:]))
    assert all(sum(tokens[a:b]) <= 200 or b == a + 1 for a, b in spans)
    assert list(windows([])) == []


def test_chunks_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two. Three."), (4, "word " * 3000)], "id long, t string")
    p = df.select("id", F.posexplode_outer(parent_texts(F.col("t"))).alias("pos", "content"))
    got = {r.id: r.content for r in p.collect() if r.content}
    assert set(got) == {3, 4}
    c = children(df, "id", "t").collect()
    assert {r.id for r in c} == {3, 4} and all(r.char_end > r.char_start for r in c)


def test_scope_must_be_named(spark):
    with pytest.raises(ValueError):
        TenantScope("")
    with pytest.raises(ValueError):
        TenantScope(1).searchable(spark.range(1))
    df = spark.createDataFrame([(1, "c", "child", "mda"), (1, "c", "parent", "mda"), (2, "c", "child", "mda")], "tenant_id int, coverage_id string, chunk_type string, section string")
    assert TenantScope(1, "c").searchable(df, F.col("section") == "mda").count() == 1



def test_fusion_prefers_what_both_lists_have(spark):
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    got = fuse([a, b]).orderBy(F.desc("score")).collect()
    assert got[0].chunk_id == "b" and len(got) == 3


def test_safe_cut_never_splits_a_citation():
    assert cut_safe("short", False) == ("", "short")
    assert cut_safe("x" * 120 + "[doc", False) == ("x" * 120, "[doc")
    whole = "x" * 120 + '[doc, mda]: "a quote of it"'
    assert cut_safe(whole, False) == (whole, "")
    assert cut_safe("[" + "x" * 2100, False)[1] == ""
    assert cut_safe("tail", True) == ("tail", "")


def test_stream_of_chunks_keeps_all_text(spark, tmp_path):
    text = "".join(f'Claim {i} [doc_{i}, mda]: "a quote long enough {i}". ' for i in range(40))
    rows = [(t, i, text[k : k + 17], k + 17 >= len(text)) for t in (1, 2) for i, k in enumerate(range(0, len(text), 17))]
    spark.createDataFrame(rows, "task_id long, seq int, text string, done boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task_id long, seq int, text string, done boolean").parquet(str(tmp_path / "in"))
    q = safe_chunks(stream).writeStream.format("memory").queryName("safe").outputMode("append").trigger(processingTime="100 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 100
    while not ((p := q.lastProgress) and p["numInputRows"] == 0 and p["batchId"] > 0) and time.time() < until and q.isActive:
        time.sleep(0.1)  # with timeouts a stream runs batches without data: the first of them shows that all is read
    q.stop()
    got = spark.sql("select task_id, text from safe").collect()
    for t in (1, 2):
        pieces = [r.text for r in got if r.task_id == t]
        assert "".join(pieces) == text and all(p.count("[") == p.count("]") for p in pieces)


def test_pieces_of_sorted_turns_whatever_the_batches():
    text = "".join(f'Claim {i} [doc_{i}, mda]: "a quote long enough {i}". ' for i in range(40))
    rows = [(t, text[k : k + 17] if t < 3 else None) for t in (1, 2, 3) for k in range(0, len(text), 17)] + [(4, "tail"), (None, "lost"), (None, " task")]
    for step in (1, 5, 1000):
        batches = [pa.RecordBatch.from_pylist(rows_, pa.schema([("task_id", pa.int64()), ("text", pa.string())])) for rows_ in ([{"task_id": t, "text": x} for t, x in rows[i : i + step]] for i in range(0, len(rows), step))]
        got = [r for b in safe_pieces(iter(batches)) for r in b.to_pylist()]
        for t, want in ((1, text), (2, text), (3, ""), (4, "tail"), (None, "lost task")):
            pieces = [r["text"] for r in got if r["task_id"] == t]
            assert "".join(pieces) == want and [r["pos"] for r in got if r["task_id"] == t] == list(range(len(pieces)))
            assert all(p.count("[") == p.count("]") for p in pieces)
    assert [b.num_rows for b in safe_pieces(iter([]))] == [0]


def test_windows_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "1 day").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.window.start, r.type, r.n) for r in df.collect())
    assert key(spark.sql("select * from win")) == key(windowed_counts(e, "1 day"))
