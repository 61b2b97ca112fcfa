"""Which documents hold a quote verbatim: shared runs of words name the candidates, ``contains`` decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

RUN = 3  # words of a seed
SHORT_BLOCK = 500  # quotes without a seed that meet all texts at a time


def _words(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+", -1)


def _seeds(words: Column, first: Column, n: Column) -> Column:
    """Hashes of n runs of RUN neighbouring words, from the one that begins at ``first``."""
    places = F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(RUN)]))


def documents_per_quote(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text: str) -> DataFrame:
    """(quote_id, n): how many texts contain each quote that some text contains.

    A text that holds a quote has the quote's inner words as whole words, in a row. So the
    three words behind a quote's first are a seed; texts explode their seeds, without the text,
    and meet the quotes by it. What meets is a candidate (hash of the text, quote), and candidates meet the texts again for ``contains``. Spark
    broadcasts quotes and candidates where they are small, and splits frequent seeds where not. Quotes
    of fewer than five words have no seed: these are a stated query set, which meets all texts in blocks.
    """
    q = quotes.select(F.col(quote_id).alias("quote_id"), F.col(quote).alias("quote")).filter("quote is not null").withColumn("words", _words(F.col("quote")))
    t = texts.select(F.col(text).alias("text")).filter("text is not null")
    seeded = F.size("words") >= RUN + 2
    seeds = q.filter(seeded).select("quote_id", _seeds(F.col("words"), F.lit(1), F.lit(1))[0].alias("seed"), "quote")
    found = t.select(F.xxhash64("text").alias("hash"), _words(F.col("text")).alias("words"))
    found = found.select("hash", F.explode(F.array_distinct(_seeds(F.col("words"), F.lit(0), F.size("words") - RUN + 1))).alias("seed"))
    candidates = found.join(seeds.select("quote_id", "seed"), "seed").select("hash", "quote_id").distinct().join(seeds.select("quote_id", "quote"), "quote_id")
    held = t.withColumn("hash", F.xxhash64("text")).join(candidates, "hash").filter(F.contains("text", "quote"))
    counts = [held.groupBy("quote_id").agg(F.count("*").alias("n"))]

    block, size = [], 0
    for row in q.filter(~seeded).select("quote_id", "quote").toLocalIterator():
        block.append((row.quote_id, row.quote))
        size += 1
        if size % SHORT_BLOCK == 0:
            counts.append(_short(t, block, q))
            block = []
    if block:
        counts.append(_short(t, block, q))
    return reduce(DataFrame.unionAll, counts).groupBy("quote_id").agg(F.sum("n").alias("n"))


def _short(texts: DataFrame, block: list, quotes: DataFrame) -> DataFrame:
    """Counts of a block of short quotes, one pass over the texts: each text gives the quotes it holds."""
    kind = quotes.schema["quote_id"].dataType
    every = F.array(*[F.struct(F.lit(i).cast(kind).alias("quote_id"), F.contains("text", F.lit(x)).alias("held")) for i, x in block])
    hit = texts.select(F.explode(F.filter(every, lambda x: x["held"])).alias("x"))
    return hit.groupBy("x.quote_id").agg(F.count("*").alias("n"))
