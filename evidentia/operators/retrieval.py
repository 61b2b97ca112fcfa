"""Hybrid retrieval: scores, postings, rank fusion, reranking, parents; scan_search.py has the searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import index_tokens, term_weight

RRF_K, BUCKETS, DENSE_THRESHOLD, SPARSE_THRESHOLD = 60, 30000, 0.92, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(scored: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """Best k per query; the rank limit is taken before the shuffle as well."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): one row per distinct token of a text. Texts are dealt out by key, which is less than their tokens would be; these are counted where they lie."""
    return df.select(key, text).repartition(key).select(key, F.explode(index_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(term_weight(F.count("*")).alias("weight"))


def hashed(index: DataFrame, key: str) -> DataFrame:
    """Tokens to buckets; what collides adds up."""
    bucket = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(BUCKETS)).cast("int")
    return index.groupBy(key, bucket.alias("bucket")).agg(F.sum("weight").alias("weight"))


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: sum of 1 / (k + rank). Ties: the earlier list, then its rank."""
    rows = reduce(DataFrame.unionByName, [df.select("query_id", "chunk_id", "rank", F.lit(i).alias("list")) for i, df in enumerate(lists)])
    parts = F.array_sort(F.collect_list(F.struct("list", "rank")))
    total = F.aggregate(F.col("parts"), F.lit(0.0), lambda s, x: s + F.lit(1.0) / (F.lit(k) + x["rank"]))
    return rows.groupBy("query_id", "chunk_id").agg(parts.alias("parts")).select("query_id", "chunk_id", F.round(total, 9).alias("score"), F.get("parts", F.lit(0)).alias("best"))


def with_parents(hits: DataFrame, parents: DataFrame, key: str = "parent_id") -> DataFrame:
    """One left join hydrates all hits at once."""
    return hits.join(parents, key, "left")
