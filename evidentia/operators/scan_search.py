"""Search by one scan: a stated query set goes to all tasks in blocks of bounded size, rows stay where they are.

A task scores its rows against the block's queries in numpy, tile by tile, and keeps the k best of each query;
one window over the tasks' bests gives the answer. No row is shuffled by a token or a
vector, so a frequent token is no hot key. Results are exact. A block counts all that a worker holds for
a query, its k best included, so that a worker's memory doesn't grow with the tables; their number does.

Sparse search scores a tile twice. The block's frequent tokens are columns of a matrix product and the others are added posting by
posting, in single precision; only pairs that can reach the query's k-th best score by that are scored from their postings in exact decimals. Where
there is more than one block of queries, the texts' tokens are written once and every block reads them.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

QUERY_BYTES = 32 << 20  # queries that go to all tasks at a time, with what a worker holds for them
BATCH_BYTES = 4 << 20  # rows that reach a worker at a time
BLOCK_DOCS = 1024  # documents of a tile
TILE_QUERIES = 512  # queries of a tile of vectors
TILE_POSTINGS = 1 << 19
FREQUENT = 2048  # tokens of a block that are columns
SLACK = 1.001  # over what single precision can lose in a sum of positive products
DIGITS = 12  # a product of two weights is summed as an integer of this many decimals


class Best:
    """The k best (score, id) of each query, equal scores by id: rows of k places, so adding touches only the queries that gain."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    @property
    def least(self) -> np.ndarray:
        """Each query's k-th best score."""
        return self.score[:, -1]

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        hope = score >= self.least[q]
        q, score, ids = q[hope], score[hope], ids[hope]
        if not len(q):
            return
        found = np.unique(q)
        q = np.concatenate([np.repeat(found, self.k), q])
        score, ids = np.concatenate([self.score[found].ravel(), score]), np.concatenate([self.id[found].ravel(), ids])
        order = np.lexsort((ids, -score, q))
        q = q[order]
        kept = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        self.score[found], self.id[found] = score[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)

    def batch(self, names: np.ndarray) -> pa.RecordBatch:
        q, at = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(self.id[q, at]), pa.array(self.score[q, at])], ["query_id", "chunk_id", "score"])


def _best_of_tasks(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], k: int) -> DataFrame:
    from .retrieval import top_k

    return top_k(rows.mapInArrow(work, "query_id long, chunk_id long, score double"), "query_id", "score", "chunk_id", k)


def _small_batches(df: DataFrame) -> None:
    """Spark's own batches are up to 64 MB, as large as the tables' partitions let them be."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_for(k: int) -> int:
    """Bytes that a worker needs for a query's k best, while they are sorted too."""
    return 48 * k


def _blocks(queries: DataFrame, bytes_of: Callable) -> Iterator[list]:
    """The query set in lists of at most QUERY_BYTES; one at a time is in the driver."""
    held, size = [], 0
    for row in queries.toLocalIterator():
        n = bytes_of(row)
        if held and size + n > QUERY_BYTES:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    yield held


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of the usual length, their vectors) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    usual = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    rows = np.flatnonzero((lengths == usual) & (lengths > 0))
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = flat.reshape(len(rows), usual) if len(rows) else np.zeros((0, usual))
    good = np.isfinite(found).all(axis=1) & (found != 0).any(axis=1)
    return rows[good], found[good]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def dense_scan(queries: DataFrame, vectors: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """Exact nearest vectors by cosine: (query_id, chunk_id, score, rank).

    queries: (query_id, query_vector[, same]), vectors: (chunk_id, vector[, same]), with integer ids. Vectors that are
    null, zero or not finite, or of another length than most of their batch, are no one's neighbour. ``same`` must agree, and null agrees with nothing.
    """
    _small_batches(vectors)
    columns = ["chunk_id", "vector"] + ([same] if same else [])

    def one(block: list) -> DataFrame:
        names = np.array([r.query_id for r in block], np.int64)
        at, q = matrix(pa.array([r.query_vector for r in block], pa.list_(pa.float64())))
        names, q, labels = names[at], unit(q), [block[i][same] if same else None for i in at]

        def work(batches):
            best = Best(len(names), k)
            for batch in batches:
                for x in range(0, batch.num_rows, BLOCK_DOCS):
                    tile(batch.slice(x, BLOCK_DOCS), best)
            yield best.batch(names)

        def tile(batch, best):
            rows, v = matrix(batch.column("vector"))
            if not len(rows) or not len(names):
                return
            v, ids = unit(v).T, batch.column("chunk_id").to_numpy()[rows]
            if same:
                theirs = batch.column(same).take(pa.array(rows)).to_pylist()
                codes = {x: i for i, x in enumerate({*labels, *theirs} - {None})}
                ours, theirs = (np.array([codes.get(x, other) for x in xs]) for xs, other in ((labels, -1), (theirs, -2)))
            for a in range(0, len(names), TILE_QUERIES):
                score = q[a : a + TILE_QUERIES] @ v
                if same:
                    score[ours[a : a + TILE_QUERIES, None] != theirs[None, :]] = -np.inf
                bar = best.least[a : a + TILE_QUERIES]
                if score.shape[1] > k and np.isneginf(bar).any():  # the first tiles set the bar; ties of the k-th stay
                    bar = np.maximum(bar, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
                at_q, row = np.nonzero((score >= bar[:, None] - 2e-9) & (score > -np.inf))
                best.add(at_q + a, np.round(score[at_q, row], 9), ids[row])

        return _best_of_tasks(vectors.select(*columns), work, k)

    return reduce(DataFrame.unionAll, [one(b) for b in _blocks(queries, lambda r: 8 * len(r.query_vector or []) + 64 + held_for(k))])


def _postings(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token number, times) of the tokens that the query set has."""
    tokens = batch.column("tokens")
    known = pc.index_in(pc.list_flatten(tokens), value_set=vocabulary)
    doc = pc.list_parent_indices(tokens).to_numpy()
    has = pc.is_valid(known).to_numpy(zero_copy_only=False)
    pair, times = np.unique(doc[has] * len(vocabulary) + known.filter(pc.is_valid(known)).to_numpy().astype(np.int64), return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), times


def _weight(times: np.ndarray) -> np.ndarray:
    return times * 2.5 / (times + 1.5)


def sparse_scan(queries: DataFrame, texts: DataFrame, k: int, query: str = "text", text: str = "content", count_postings: bool = False) -> DataFrame:
    """Dot products of term weights over shared tokens: (query_id, chunk_id, score, rank), zero scores left out.

    queries: (query_id, text), texts: (chunk_id, content), with integer ids. With ``count_postings`` each task gives instead (query_id: -1,
    chunk_id: postings read, score: postings there are) of query times document.
    """
    from ..functions.text import index_tokens
    from .retrieval import top_k

    _small_batches(texts)
    asked = queries.select("query_id", index_tokens(F.col(query)).alias("tokens")).filter("size(tokens) > 0")
    # One string a text: Arrow takes it as it is, where each element of a list is written by itself.
    rows = texts.select("chunk_id", F.array_join(index_tokens(F.col(text)), " ").alias("tokens"))

    def one(block: QueryBlock) -> DataFrame:
        names, words, first, qtoken, qw = block.arrays()
        asks = np.bincount(qtoken, minlength=len(words))  # a token's queries
        column = np.empty(len(words), np.int64)
        column[np.argsort(-asks, kind="stable")] = np.arange(len(words))
        width = min(FREQUENT, len(words))
        of = np.repeat(np.arange(len(names)), np.diff(first))
        rare = np.flatnonzero(column[qtoken] >= width)
        rare = rare[np.argsort(qtoken[rare], kind="stable")]
        rare_q, rare_w = of[rare], qw[rare]
        rare_first = np.searchsorted(qtoken[rare], np.arange(len(words) + 1))

        def dense(row, token, weight, n):
            out = np.zeros((n, width), np.float32)
            at = np.flatnonzero(column[token] < width)
            out[row[at], column[token[at]]] = weight[at]
            return out

        def rare_scores(doc, token, weight, n_docs):
            """Queries by documents, a slice of the postings at a time."""
            out = np.zeros(len(names) * n_docs, np.float32)
            n = rare_first[token + 1] - rare_first[token]
            at = np.flatnonzero(n)
            upto = np.cumsum(n[at])
            for x in range(0, int(upto[-1]) if len(at) else 0, TILE_POSTINGS):
                p = at[np.searchsorted(upto, x, side="right") : np.searchsorted(upto, x + TILE_POSTINGS, side="right")]
                k_ = n[p]
                if len(p):
                    j = np.arange(k_.sum()) + np.repeat(rare_first[token[p]] - (np.cumsum(k_) - k_), k_)
                    np.add.at(out, rare_q[j] * n_docs + np.repeat(doc[p], k_), (np.repeat(weight[p], k_) * rare_w[j]).astype(np.float32))
            return out.reshape(len(names), n_docs)

        def work(batches):
            best, read, every = Best(len(names), k), 0, 0
            vocabulary = pa.array(words, pa.string())
            frequent = dense(of, qtoken, qw, len(names))
            mine = np.zeros(len(words))  # one document's weights at a time
            for ids, doc, token, times in _tiles(batches, vocabulary):
                weight = _weight(times)
                start = np.searchsorted(doc, np.arange(len(ids) + 1))
                every += int(asks[token].sum()) if count_postings else 0
                top = rare_scores(doc, token, weight, len(ids))
                top += frequent @ dense(doc, token, weight, len(ids)).T
                bar = np.maximum(best.least, 1e-9)
                new = np.flatnonzero(bar < 1e-6)
                if len(new) and len(ids) > k:  # the first tiles set the bar
                    bar[new] = np.maximum(np.partition(top[new], len(ids) - k, axis=1)[:, len(ids) - k] / SLACK - 1e-6, 1e-9)
                hope = top >= (bar / SLACK)[:, None]
                d, z = np.nonzero(hope.T)
                asked_by, total = np.searchsorted(d, np.arange(len(ids) + 1)), np.zeros(len(d), np.int64)
                for x in np.flatnonzero(np.diff(asked_by)).tolist():
                    s, mine_at = slice(asked_by[x], asked_by[x + 1]), token[start[x] : start[x + 1]]
                    mine[mine_at] = weight[start[x] : start[x + 1]]
                    total[s], n = exact(z[s], mine)
                    read += n
                    mine[mine_at] = 0.0
                some = total > 0
                best.add(z[some], np.round(total[some] / 10**DIGITS, 6), ids[d[some]])
            if count_postings:
                yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([read]), pa.array([float(every)])], ["query_id", "chunk_id", "score"])
            else:
                yield best.batch(names)

        def exact(z, mine):
            """(the queries' scores as integers, postings shared) of the document whose weights are ``mine``."""
            n = first[z + 1] - first[z]
            upto, total, read, a = np.cumsum(n), np.zeros(len(z), np.int64), 0, 0
            while a < len(z):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] - n[a] + TILE_POSTINGS, side="right")))
                begin = upto[a:b] - n[a:b] - (upto[a] - n[a])
                at = np.arange(n[a:b].sum()) + np.repeat(first[z[a:b]] - begin, n[a:b])
                product = np.rint(qw[at] * mine[qtoken[at]] * 10**DIGITS).astype(np.int64)
                total[a:b] = np.add.reduceat(product, begin)
                read, a = read + np.count_nonzero(product), b
            return total, read

        return rows.mapInArrow(work, "query_id long, chunk_id long, score double")

    blocks = _query_blocks(asked, k)
    first, second = next(blocks), next(blocks, None)
    if second:
        rows = _kept(rows)
    found = reduce(DataFrame.unionAll, [one(b) for b in chain([first], [second] if second else [], blocks)])
    return found if count_postings else top_k(found, "query_id", "score", "chunk_id", k)


def _kept(rows: DataFrame) -> DataFrame:
    """The rows, written once, as each block would split the texts again. A task takes its share of them all, so that few tasks begin without a bar."""
    from ..sources.shared import shared_folder

    spark = rows.sparkSession
    path = shared_folder(spark, "tokens")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path).coalesce(2 * spark.sparkContext.defaultParallelism)


def _tiles(batches, vocabulary: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, document, token number, times) of at most BLOCK_DOCS documents and, unless one alone has more, TILE_POSTINGS words."""
    for batch in batches:
        if not len(vocabulary) or not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays([batch.column("chunk_id"), pc.split_pattern(batch.column("tokens"), " ")], ["chunk_id", "tokens"])
        words = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            full = np.searchsorted(words, (words[a - 1] if a else 0) + TILE_POSTINGS, side="right")
            b = min(a + BLOCK_DOCS, max(a + 1, int(full)), batch.num_rows)
            part = batch.slice(a, b - a)
            yield part.column("chunk_id").to_numpy(), *_postings(part, vocabulary)
            a = b


class QueryBlock:
    """Some queries' token weights in flat arrays."""

    def __init__(self):
        self.names, self.number, self.first, self.token, self.weight = [], {}, [0], array("q"), array("d")
        self.size = 0

    def add(self, name: int, counts: Counter, k: int) -> None:
        self.names.append(name)
        for word, n in counts.items():
            if word not in self.number:
                self.size += len(word) + 64
            self.token.append(self.number.setdefault(word, len(self.number)))
            self.weight.append(n * 2.5 / (n + 1.5))
        self.first.append(len(self.token))
        self.size += 4 * FREQUENT + 13 * BLOCK_DOCS + 16 * len(counts) + held_for(k)

    def arrays(self):
        return np.array(self.names, np.int64), list(self.number), np.array(self.first), np.array(self.token, np.int64), np.array(self.weight, np.float64)


def _query_blocks(asked: DataFrame, k: int) -> Iterator[QueryBlock]:
    """Blocks of at most about QUERY_BYTES; rows of one query are one query, in one block."""
    block = QueryBlock()
    for name, rows in groupby(asked.orderBy("query_id").toLocalIterator(), lambda r: r.query_id):
        if block.size > QUERY_BYTES:
            yield block
            block = QueryBlock()
        counts = Counter()
        for row in rows:
            counts.update(row.tokens)
        block.add(name, counts, k)
    yield block
