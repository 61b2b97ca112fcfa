"""Hierarchical chunks: paragraphs packed into parents, sentences into overlapping children."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.finance import let
from ..functions.text import chunk_sentences, paragraphs, token_estimate

PARENT_TOKENS, CHILD_TOKENS, OVERLAP_TOKENS = 2000, 200, 20
SLICE_BYTES = 1 << 20


def parent_texts(text: Column, limit: int = PARENT_TOKENS) -> Column:
    """Paragraphs packed in order; a new parent begins where the next one would pass the limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("tokens"))

    def add(acc, p):
        full = (acc["open"] != "") & (acc["tokens"] + token_estimate(p) > limit)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["open"] == ""), p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p)).alias("open"),
            F.when(full, token_estimate(p)).otherwise(acc["tokens"] + token_estimate(p)).alias("tokens"),
        )

    return F.aggregate(paragraphs(text), start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def windows(tokens: list[int], limit: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS):
    """(start, end) of sentence groups of at most ``limit`` tokens; the next group repeats about ``overlap`` of them."""
    upto, start = [0, *accumulate(tokens)], 0
    while start < len(tokens):
        end = max(start + 1, bisect_right(upto, upto[start] + limit) - 1)
        yield start, end
        if end >= len(tokens):
            return
        start = max(start + 1, bisect_right(upto, upto[end] - overlap) - 1)


def _slices(batches):
    """Rows by SLICE_BYTES of Arrow data, or one alone: texts are Python objects a slice at a time, however large Spark's batches are."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def children(parents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, child, content, char_start, char_end, token_estimate) of every parent's text."""
    rows = parents.select(F.col(key).alias("k"), F.col(text).alias("t"), chunk_sentences(F.col(text)).alias("s"))
    rows = rows.withColumn("n", F.transform("s", token_estimate))

    def split(batches):
        for batch in _slices(batches):
            out = []
            for k, t, s, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at, places = 0, []
                for sentence in s or ():
                    found = (t or "").find(sentence, at)
                    at = (found if found >= 0 else at) + len(sentence)
                    places.append((at - len(sentence), at))
                for i, (a, b) in enumerate(windows(n or [])):
                    out.append((k, i, " ".join(s[a:b]), places[a][0], places[b - 1][1]))
            c = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.schema.field(0).type), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], ["k", "child", "content", "char_start", "char_end"])

    kind = parents.schema[key].dataType.simpleString()
    out = rows.mapInArrow(split, f"k {kind}, child int, content string, char_start int, char_end int")
    return out.select(F.col("k").alias(key), "child", "content", "char_start", "char_end", token_estimate(F.col("content")).alias("token_estimate"))


def child_counts(parents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n): how many children each parent has, from its sentences' token counts alone; no text goes to Python."""
    rows = parents.select(F.col(key).alias("k"), F.transform(chunk_sentences(F.col(text)), token_estimate).alias("n"))

    def count(batches):
        for batch in _slices(batches):
            n = [sum(1 for _ in windows(tokens or [])) for tokens in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["k", "n"])

    return rows.mapInArrow(count, f"k {parents.schema[key].dataType.simpleString()}, n long").withColumnRenamed("k", key)


def grid_markdown(rows: Column) -> Column:
    """array<array<string>> to a pipe table: the first row is the header, others padded or cut to its width."""

    def draw(g):
        width = F.size(F.get(g, F.lit(0)))
        line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
        fit = lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))
        rule = line(F.array_repeat(F.lit("---"), width))
        return F.array_join(F.concat(F.array(line(F.get(g, F.lit(0))), rule), F.transform(F.slice(g, F.lit(2), F.size(g)), lambda r: line(fit(r)))), "\n")

    return let(rows, draw)


def grid_json(rows: Column) -> Column:
    """[{label, values: {header: value}}] as JSON; the first column is the label, of equal headers the last wins."""

    def draw(g):
        header = F.slice(F.get(g, F.lit(0)), F.lit(2), F.size(F.get(g, F.lit(0))))

        def cells(r):
            pairs = F.transform(header, lambda h, i: F.struct(h.alias("key"), F.coalesce(F.get(r, i + 1), F.lit("")).alias("value")))
            last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
            return F.struct(F.get(r, F.lit(0)).alias("label"), F.map_from_entries(last).alias("values"))

        return F.to_json(F.transform(F.slice(g, F.lit(2), F.size(g)), cells))

    return let(rows, draw)
