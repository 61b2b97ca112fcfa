"""Benchmark decontamination by greedy string tiling (running Karp-Rabin).

A document and a test item are compared: the longest common run of words that is
not yet marked on either side is marked as a tile, again and again, down to runs
of ``TILE_WORDS``. The share of the item's words under tiles is its coverage,
wherever and in whatever order the tiles lie in the document, so reordered
passages count too.

Seeds are all runs of ``TILE_WORDS`` words of the items. A tile of n words holds n - 2
seeds, a third of n at least, so a document that has fewer of an item's seeds
than a third of the words to cover can't cover it; all others are tiled: no
pair is lost. The seeds go to all tasks in blocks of at most ``BLOCK_WORDS`` words, one
block in the driver at a time; a larger benchmark takes several passes.

Defined results: words are lower-cased, outer ASCII punctuation off; null or
empty texts on either side match nothing; items shorter than a seed are their
own seed; rows that repeat an id are searched each on its own, as are equal
items; empty tables give no rows. Columns besides ids and texts are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel
from .toxicity import PUNCTUATION

U = np.uint64
TILE_WORDS, COVERAGE, BLOCK_WORDS = 3, 0.8, 2_000_000
FOUND = "doc_id {}, item_id {}, n_tiles int, covered_words int, item_words int, coverage double"


def word_ids(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without outer punctuation, and words before each text."""
    data = kernel.LOWER[data]
    start, end, at = kernel.words(data, offs)
    for _ in range(4 if len(end) else 0):
        end = end - (PUNCTUATION[data[end - 1]] & (end - start > 1))
        start = start + (PUNCTUATION[data[start]] & (end - start > 1))
    return kernel.span_hashes(data, start, end), at


def tiles(doc: np.ndarray, item: np.ndarray, least: int = TILE_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (place in doc, place in item, length), longest first."""
    # Only runs of words that the item has can hold a tile; the rest of the document is skipped.
    inside = np.isin(doc, item)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]
    d_free, i_free = np.zeros(len(doc), bool), np.ones(len(item), bool)
    for a, b in runs:
        d_free[a:b] = True
    words, wanted, found = doc.tolist(), item.tolist(), []
    size = max([least, *(min(b - a, len(item)) for a, b in runs)])
    while runs and len(item) >= least:
        # All maximal matches of at least `size` words among unmarked words, by hashes of `size` words.
        starts: dict[int, list[int]] = {}
        for k, h in enumerate(kernel.ngram_hashes(item, size).tolist()):
            if i_free[k : k + size].all():
                starts.setdefault(h, []).append(k)
        matches = []
        for a, b in runs:
            for p, h in enumerate(kernel.ngram_hashes(doc[a:b], size).tolist(), a):
                for q in starts.get(h, ()) if d_free[p : p + size].all() else ():
                    if p and q and d_free[p - 1] and i_free[q - 1] and words[p - 1] == wanted[q - 1]:
                        continue  # not the left end of this match
                    n = 0
                    while p + n < b and q + n < len(wanted) and d_free[p + n] and i_free[q + n] and words[p + n] == wanted[q + n]:
                        n += 1
                    if n >= size:
                        matches.append((n, p, q))
        # The longest first; what is left of a match on both sides of a longer tile waits for its turn.
        heap = [(-n, p, q) for n, p, q in matches]
        heapq.heapify(heap)
        while heap:
            n, p, q = heapq.heappop(heap)
            free = d_free[p : p - n] & i_free[q : q - n]
            if free.all():
                d_free[p : p - n] = i_free[q : q - n] = False
                found.append((p, q, -n))
                continue
            cut = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
            for a, b in zip(cut[::2].tolist(), cut[1::2].tolist()):
                if b - a >= size:
                    heapq.heappush(heap, (a - b, p + a, q + a))
        if size == least:
            break
        size = max(least, size // 2)
    return found


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[Searcher]:
    """Searchers of BLOCK_WORDS words each, or a little more, one after the other."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    blocks = int((items.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0] or 0) // BLOCK_WORDS) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield Searcher(items.filter(block == k).toPandas())


class Searcher:
    """The seeds of a block of test items; goes to the tasks."""

    def __init__(self, items):
        self.names = items.item_id.tolist()
        w, at = word_ids(*kernel.as_bytes(pa.array(items.text.tolist(), pa.string())))
        self.sequences = [w[a:b] for a, b in zip(at[:-1], at[1:])]
        self.words = np.array([len(s) for s in self.sequences], np.int64)
        seeds = [kernel.ngram_hashes(s, min(TILE_WORDS, len(s))) if len(s) else s for s in self.sequences]
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds]).astype(np.int64)
        seed = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        self.seed, back = np.unique(seed, return_inverse=True)
        # How often each item has each seed: a document's seeds count in the item with their number of places.
        pair, times = np.unique(back.astype(np.int64) * max(len(seeds), 1) + owner, return_counts=True)
        self.owner, self.times = pair % max(len(seeds), 1), times
        self.at = np.searchsorted(pair // max(len(seeds), 1), np.arange(len(self.seed) + 1))
        self.lengths = sorted({min(TILE_WORDS, len(s)) for s in self.sequences if len(s)})

    def found(self, column: pa.Array, coverage: float):
        """(row, item number, tiles) of the texts that cover an item."""
        data, offs = kernel.as_bytes(column)
        least = np.where(self.words < TILE_WORDS, 1, np.ceil(coverage * self.words / TILE_WORDS - 1e-9))
        for i, j in kernel.slices(offs) if len(self.seed) else ():
            w, at = word_ids(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            hits = []
            for n in self.lengths:
                h = kernel.ngram_hashes(w, n)
                lo = np.minimum(np.searchsorted(self.seed, h), len(self.seed) - 1)
                hit = np.flatnonzero(self.seed[lo] == h)
                doc = np.searchsorted(at, hit, "right") - 1
                whole = hit + n <= at[doc + 1]  # not across two texts
                hits.append(doc[whole] * len(self.seed) + lo[hit][whole])
            hits = np.unique(np.concatenate(hits))  # each seed once per document
            for d0, d1 in self._portions(hits, j - i):
                part = hits[d0:d1]
                doc, seed = part // len(self.seed), part % len(self.seed)
                size = self.at[seed + 1] - self.at[seed]
                place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - self.at[seed], size)
                pair, back = np.unique(np.repeat(doc, size) * len(self.names) + self.owner[place], return_inverse=True)
                enough = np.bincount(back, self.times[place], len(pair)) >= least[pair % len(self.names)]
                for d, k in zip((pair[enough] // len(self.names)).tolist(), (pair[enough] % len(self.names)).tolist()):
                    item = self.sequences[k]
                    tiled = tiles(w[at[d] : at[d + 1]], item, min(TILE_WORDS, len(item)))
                    if sum(n for _, _, n in tiled) >= coverage * len(item):
                        yield i + d, k, tiled

    def _portions(self, hits: np.ndarray, docs: int):
        """Ranges of hits of whole documents that make about a million (document, item) pairs each."""
        seed = hits % len(self.seed)
        upto = np.concatenate([[0], np.cumsum(self.at[seed + 1] - self.at[seed])])
        edge = np.searchsorted(hits, np.arange(docs + 1) * len(self.seed))
        a = 0
        while a < docs:
            b = max(a + 1, int(np.searchsorted(upto[edge], upto[edge[a]] + 1_000_000, "right")) - 1)
            yield int(edge[a]), int(edge[min(b, docs)])
            a = b


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_tiles, covered_words, item_words, coverage) of the pairs whose item is covered enough."""
    item_type = benchmark.schema[item_id].dataType
    schema = FOUND.format(docs.schema[doc_id].dataType.simpleString(), item_type.simpleString())
    item_type = to_arrow_type(item_type)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def search(searcher):
        def work(batches):
            for batch in batches:
                out = []
                for row, k, tiled in searcher.found(batch.column("text"), coverage):
                    covered, words = sum(n for _, _, n in tiled), len(searcher.sequences[k])
                    out.append((row, searcher.names[k], len(tiled), covered, words, covered / words))
                c = list(zip(*out)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(c[0], pa.int64())), pa.array(c[1], item_type), *(pa.array(x, pa.int32()) for x in c[2:5]), pa.array(c[5], pa.float64())], ["doc_id", "item_id", "n_tiles", "covered_words", "item_words", "coverage"])

        return work

    return reduce(DataFrame.unionAll, [rows.mapInArrow(search(s), schema) for s in _blocks(benchmark, item_id, item_text)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """The rows that cover no test item, with all their columns; nothing is shuffled."""

    def drop(searcher):
        def work(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _, _ in searcher.found(batch.column(text), coverage)]] = False
                yield batch.filter(pa.array(keep))

        return work

    for searcher in _blocks(benchmark, "item_id", "text"):
        docs = docs.mapInArrow(drop(searcher), docs.schema)
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
