"""Importance resampling towards a target corpus, with bags of hashed n-grams.

A document's features are its runs of 1 to ``longest`` neighbouring words; crc32 of
the joined words gives a feature's bucket. Every block of texts in a task gets
word ids and a suffix array over them: suffixes in order of their first ``longest``
words, with the longest common prefixes of neighbours. Where that prefix falls under
k begins another k-gram, so the array lists each distinct n-gram once, as one run of
its occurrences. It is hashed once per run, and the bucket id is scattered back to
the run's places. Counting sums the runs; scoring sums gains per place.

What a task sends on are bucket counts (at most ``buckets`` rows after the map-side
sum) and one row of numbers per document. Gains go out as one row per bucket, a number that
is a parameter. Ranks come from a range-dealt sort and one row per partition, so no
task sees all scores.

Defined results: a null text or a text without words has no features, weight 0 and no
rank; a null id is an empty one in the key of its noise; every row is one document, also when
ids repeat (equal scores and ids then go by n_features, weight and place in the scan); no
documents give no rows; without target texts, all gains are those of t = T = 0.
Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernel
from .workspace import Workspace

SLICE = 4_000_000  # bytes of texts that get one suffix array
# Fixed values of the word rule: bytes that are part of a word, after A-Z have become a-z.
PART = np.zeros(256, bool)
PART[np.r_[48:58, 97:123, 128:256]] = True


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased bytes, and the number of words before each text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = PART[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True  # no word reaches over the end of a text
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first))
    end = np.flatnonzero(before & (~inside | first))
    return start, end, np.searchsorted(start, offs)


def suffix_array(ids: np.ndarray, text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of their first ``longest`` words within their text, and the common prefix with the place before.

    ids: one number per word; text: each word's text. Prefixes over ``longest`` words count as that long.
    """
    n = len(ids)
    columns = []
    for k in range(longest):
        column = np.full(n, -1, np.int64)  # behind the text's end
        if k < n:
            same = text[: n - k] == text[k:]
            column[: n - k][same] = ids[k:][same]
        columns.append(column)
    order = np.lexsort(columns[::-1]) if longest > 1 else np.argsort(columns[0], kind="stable")
    lcp, alike = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for column in columns:
        sorted_ = column[order]
        alike &= (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] >= 0)
        lcp[1:] += alike
    return order, lcp


def buckets_of(data: np.ndarray, offs: np.ndarray, longest: int, buckets: int):
    """Per k: (places of k-grams grouped by run, each run's length, each run's bucket), and the number of words before each text."""
    data = kernel.LOWER[data]
    start, end, at = word_spans(data, offs)
    if not len(start):
        return [], at
    _, where, ids = np.unique(kernel.span_hashes(data, start, end), return_index=True, return_inverse=True)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    order, lcp = suffix_array(ids, text, longest)
    raw = data.tobytes()
    word = [raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())]
    left = at[text + 1] - np.arange(len(ids))  # words up to the text's end
    found = []
    for k in range(1, longest + 1):
        whole = left[order] >= k
        places = order[whole]
        begins = np.flatnonzero(lcp[whole] < k)  # a run's members are neighbours, so no shorter suffix parts them
        heads = places[begins]
        grams = (b" ".join(word[i] for i in row) for row in ids[heads[:, None] + np.arange(k)].tolist())
        bucket = np.fromiter((zlib.crc32(g) % buckets for g in grams), np.int64, len(heads))
        found.append((places, np.diff(np.append(begins, len(places))), bucket))
    return found, at


def bucket_counts(docs: DataFrame, longest: int, buckets: int, text: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall in each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offs = kernel.as_bytes(batch.column("text"))
            for i, j in kernel.slices(offs, SLICE):
                for _, length, bucket in buckets_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], longest, buckets)[0]:
                    total += np.bincount(bucket, length, buckets).astype(np.int64)
        kernel.trim()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: floor(1000 * ln of the target's share over the source's), each count one up; a row per bucket."""
    spark = source.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    rows = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = Window.partitionBy()  # a row per bucket
    up = lambda c, more: (F.col(c) + more).cast("double")
    rows = rows.withColumns({"ss": F.sum("s").over(whole), "tt": F.sum("t").over(whole)})
    ratio = (up("t", 1) * up("ss", buckets)) / (up("s", 1) * up("tt", buckets))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def document_weights(docs: DataFrame, gains: list[int], longest: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight (the sum of its features' gains)."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def score(batches):
        gain = sent.value
        for batch in batches:
            data, offs = kernel.as_bytes(batch.column("text"))
            for i, j in kernel.slices(offs, SLICE):
                found, at = buckets_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], longest, len(gain))
                features, total = np.zeros(at[-1] + 1, np.int64), np.zeros(at[-1] + 1, np.int64)
                for places, length, bucket in found:
                    features[places + 1] += 1
                    total[places + 1] += np.repeat(gain[bucket], length)
                features, total = np.cumsum(features)[at], np.cumsum(total)[at]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), pa.array(np.diff(features)), pa.array(np.diff(total))], ["doc_id", "n_words", "n_features", "weight"])
        kernel.trim()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_features long, weight long")


def noisy_score(seed: int):
    """weight plus Gumbel noise in thousandths, from the id alone: the same in every run and partitioning."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_features, weight, score, and the rank of those drawn (null for the others).

    Of the N documents with ``min_words`` words, the floor(percent * N / 100) of highest score are drawn
    (Gumbel top-k: sampling without replacement by importance weight).
    """
    spark = docs.sparkSession
    space = Workspace(spark, "resampling")
    gains = bucket_gains(bucket_counts(docs, longest, buckets, text), bucket_counts(target, longest, buckets, text), buckets)
    gains = [r.gain for r in gains.orderBy("bucket").collect()]  # as many as there are buckets
    rows = document_weights(docs, gains, longest, text, doc_id).withColumn("score", noisy_score(seed)).withColumn("place", F.monotonically_increasing_id())
    rows = space.save(rows, "scores")
    able = rows.filter(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.desc("weight"), F.asc("place")]
    # A row's number in its partition, from ids that Spark deals out in the partition's order.
    ordered = able.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_features", "weight", "score", "place", F.monotonically_increasing_id().alias("at"))
    ordered = space.save(ordered, "ordered").withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), (F.sum("n").over(Window.partitionBy()) * percent / 100).cast("long").alias("drawn"))
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.join(starts, "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))
    rest = rows.filter(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionAll(rest)


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark"), longest=1)


_CRC = """
crc_table AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b)))"""


def crc_sql(value: str) -> str:
    """SQL for the crc32 of a text's UTF-8 bytes; it reads ``t`` of crc_table."""
    octets = f"list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"


ORACLE = f"""
WITH {_CRC.strip()},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word FROM d),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
v AS (SELECT word, {crc_sql('word')} % 10000 AS bucket FROM (SELECT word FROM w UNION SELECT word FROM b), crc_table),
s AS (SELECT bucket, count(*) AS s FROM w JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (word) GROUP BY bucket),
g AS (SELECT r.bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM w JOIN v USING (word) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT d.doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN x USING (doc_id)),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT y.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM y LEFT JOIN z USING (doc_id)
"""
