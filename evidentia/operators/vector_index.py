"""Approximate nearest vectors: inverted lists over trained centroids, product-quantised residuals, exact re-check.

Centroids and code words are trained on a bounded sample that a hash picks (SAMPLE vectors); every vector is assigned to
its list and coded where it lies. The index is a Parquet table partitioned by list, dealt by ranges of (list, hash), so a
large list is several files and tasks. A search names its lists before it reads: the scan prunes the others.
Queries go out in blocks of bounded size. Per query each task keeps the best candidates by their codes; the best of all
tasks meet their vectors again, and exact cosines decide.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import Folder
from .retrieval import cosine, top_k
from .scan_search import BLOCK_DOCS, TILE_QUERIES, Best, _blocks, _small_batches, held_for, matrix, unit

SAMPLE = 20_000
MOST_LISTS = 4096
ROUNDS = 12


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (x[a : a + 4096] @ centres.T - half).argmax(axis=1)
    return out


def k_means(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from distinct rows; an empty cluster takes the row that is worst served."""
    g = np.random.Generator(np.random.PCG64(seed))
    distinct = np.unique(x, axis=0)
    centres = distinct[g.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        far = ((x - centres[at]) ** 2).sum(axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


class VectorIndex:
    """build() writes an index, VectorIndex(spark, path) opens it, search() asks it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        model = json.loads(Folder(spark, path).read("model.json"))
        self.centres, self.words = np.array(model["centres"]), [np.array(w) for w in model["words"]]
        self.cuts = model["cuts"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, parts: int = 8, words: int = 256) -> VectorIndex:
        """vectors: (chunk_id, vector), integer ids. Vectors that are null, zero, not finite or of an unusual length aren't indexed."""
        spark = vectors.sparkSession
        _small_batches(vectors)
        n = vectors.count()
        share = min(1.0, SAMPLE / max(n, 1))
        picked = vectors.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vector").limit(2 * SAMPLE)
        _, x = matrix(pa.array([r.vector for r in picked.toLocalIterator()], pa.list_(pa.float64())))
        if not len(x):
            raise ValueError("no vectors to train on")
        x = unit(x)
        centres = k_means(x, lists or min(MOST_LISTS, max(1, int(np.sqrt(n)))))
        cuts = [int(c) for c in np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1)]
        residual = x - centres[_nearest(x, centres)]
        books = [k_means(residual[:, a:b], words) for a, b in zip(cuts, cuts[1:])]

        def assign(batches):
            for batch in batches:
                rows, v = matrix(batch.column("vector"))
                good = np.full(len(rows), v.shape[1] == centres.shape[1])
                rows, v = rows[good], v[good]
                if not len(rows):
                    continue
                v = unit(v)
                at = _nearest(v, centres)
                rest = v - centres[at]
                codes = np.stack([_nearest(rest[:, a:b], w) for (a, b), w in zip(zip(cuts, cuts[1:]), books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("chunk_id").take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["chunk_id", "list", "codes"])

        coded = vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector").mapInArrow(assign, "chunk_id long, list int, codes binary")
        coded.repartitionByRange("list", F.xxhash64("chunk_id")).sortWithinPartitions("list", "chunk_id").write.partitionBy("list").parquet(f"{path}/lists")
        Folder(spark, path).write_new("model.json", json.dumps({"centres": centres.tolist(), "words": [w.tolist() for w in books], "cuts": cuts}))
        return cls(spark, path)

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema("chunk_id long, codes binary, list int").parquet(f"{self.path}/lists")
        return rows if lists is None else rows.filter(F.col("list").isin(lists))

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """Each query's nearest lists."""
        probes = min(probes, len(self.centres))
        return np.argpartition(-(q @ self.centres.T - (self.centres**2).sum(axis=1) / 2), probes - 1, axis=1)[:, :probes]

    def candidates(self, block: list, k: int, probes: int) -> DataFrame:
        """(query_id, chunk_id, score by codes, rank) of the k best in the probed lists."""
        return top_k(self.scored(block, k, probes), "query_id", "score", "chunk_id", k)

    def scored(self, block: list, k: int, probes: int) -> DataFrame:
        """(query_id, chunk_id, score by codes): each task's k best of each query. Tasks get the block's vectors and work out what the code words give a query for a tile of queries at a time."""
        names = np.array([r.query_id for r in block], np.int64)
        at, q = matrix(pa.array([r.query_vector for r in block], pa.list_(pa.float64())))
        names, q = names[at], unit(q)
        lists = self.probed(q, probes) if len(q) else np.zeros((0, 1), np.int64)
        asking = np.argsort(lists, axis=None, kind="stable")
        numbers, first = np.unique(lists.ravel()[asking], return_index=True)
        asking, first = asking // lists.shape[1], np.append(first, len(asking))
        centres, parts = self.centres, [(slice(a, b), w.T) for (a, b), w in zip(zip(self.cuts, self.cuts[1:]), self.words)]

        def work(batches):
            best = Best(len(names), k)
            for batch in batches:
                ids, where = batch.column("chunk_id").to_numpy(), batch.column("list").to_numpy(zero_copy_only=False)
                if not len(ids):
                    continue
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
                found, there, _ = np.intersect1d(numbers, where, return_indices=True)
                for x, i in zip(found.tolist(), there.tolist()):
                    asked, rows = asking[first[i] : first[i + 1]], np.flatnonzero(where == x)
                    for a in range(0, len(asked), TILE_QUERIES):
                        tile(asked[a : a + TILE_QUERIES], x, ids[rows], codes[rows], best)
            yield best.batch(names)

        def tile(asked, x, ids, codes, best):
            base, tables = q[asked] @ centres[x], [q[asked, cut] @ w for cut, w in parts]  # queries by code words
            for a in range(0, len(ids), BLOCK_DOCS):
                some = codes[a : a + BLOCK_DOCS]
                score = base[:, None] + sum(t[:, some[:, i]] for i, t in enumerate(tables))
                at_q, row = np.nonzero(score >= best.least[asked][:, None])
                best.add(asked[at_q], score[at_q, row], ids[a + row])

        every = len(numbers) == len(self.centres)
        rows = self.rows(None if every else numbers.tolist())
        # Lists are many small files: a task takes its share of them, one after the other.
        return rows.coalesce(2 * self.spark.sparkContext.defaultParallelism).mapInArrow(work, "query_id long, chunk_id long, score double")

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, probes: int = 32, recheck: int = 20) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k nearest by exact cosine among ``recheck`` * k candidates.

        queries: (query_id, query_vector); vectors: the indexed table, read again for the candidates only. A block counts what a worker
        holds for a query: its vector, its lists and its best candidates.
        """
        _small_batches(vectors)
        most = recheck * k
        blocks = _blocks(queries, lambda r: 8 * len(r.query_vector or []) + 64 + 8 * probes + held_for(most))
        found = top_k(reduce(DataFrame.unionAll, [self.scored(b, most, probes) for b in blocks]), "query_id", "score", "chunk_id", most)
        pairs = found.select("query_id", "chunk_id").join(vectors.select("chunk_id", "vector"), "chunk_id").join(queries.select("query_id", "query_vector"), "query_id")
        return top_k(pairs.select("query_id", "chunk_id", F.round(cosine(F.col("query_vector"), F.col("vector")), 9).alias("score")), "query_id", "score", "chunk_id", k)
