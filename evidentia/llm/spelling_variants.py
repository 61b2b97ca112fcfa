"""Spelling variants: words one edit apart, grouped under their most frequent form.

Two words that differ by one inserted, deleted or replaced code point share their first
or their last half (half of the shorter one, rounded down). So each word stands twice in
a forward dictionary, in blocks of words with one prefix, and twice in a reversed one,
in blocks with one suffix: once as the shorter word of a pair and once as the longer.
Blocks are dealt out and scanned in order. A block of more than ``block`` words is
subdivided by the same rule: what lies between the parts known to agree holds the edit, so one
half of it agrees as well, and the words move to blocks with a longer prefix or a longer
suffix, until the blocks are small or a single place is left open (then
all its words are near each other, and only an alphabet's worth of them exist). No block is cut and no
word left out. In a block, pairs are verified by their common prefix and suffix; a pair that
several blocks hold counts in the one where the prefix comes first at each step.

Only distinct words are dealt out; counts add up in the tasks first. Hot words are rows like others.

Defined results: a null text has no words; a null id is an empty one in the key that picks code points to
delete; every row is one document, also when ids repeat; ties of near words go by code points;
no words give no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernel, runs
from .lattice_lm import spans_array
from .ngram_resampling import _CRC, crc_sql
from .workspace import Workspace

SLICE = 4_000_000
BLOCK = 128  # words: larger blocks are subdivided
PAIRS = 1 << 18  # pairs that are compared at once
NO_CAP = (1 << 31) - 1
# The polynomial of crc32, bit-reversed; letters are A-Z, a-z and U+00C0 to U+00FF (two bytes, the first of them C3).
POLYNOMIAL, LEAD = 0xEDB88320, 0xC3
LETTER = np.zeros(256, bool)
LETTER[np.r_[65:91, 97:123, LEAD]] = True


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def crc_of_pairs(prefix: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of prefix + word from the crc32 of each and the words' lengths: the prefix's goes on through that many zero bytes."""
    table, out, order = crc_table(), np.empty(len(crc), np.uint32), np.argsort(length, kind="stable")
    state, sorted_, done = prefix.astype(np.uint32)[order], length[order], 0
    for n in range(int(length.max(initial=0)) + 1):
        upto = int(np.searchsorted(sorted_, n, "right"))
        out[order[done:upto]] = state[: upto - done]
        state, done = state[upto - done :], upto
        state = (state >> np.uint32(8)) ^ table[state & np.uint32(255)]
    return out ^ crc


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and the number of runs before each text."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = LETTER[data]
    inside[1:] |= data == LEAD
    inside[len(data)] = False
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first))
    return start, np.flatnonzero(before & (~inside | first)), np.searchsorted(start, offs)


def word_counts(docs: DataFrame, typo_every: int, min_length: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: lower-cased runs of letters; where ``typo_every`` divides crc32(id:run), the run loses a code point."""

    def count(batches):
        for batch in batches:
            data, offs = kernel.as_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in kernel.slices(offs, SLICE):
                part = kernel.LOWER[data[offs[i] : offs[j]]]
                start, end, at = letter_runs(part, offs[i : j + 1] - offs[i])
                if not len(start):
                    continue
                _, where, word = np.unique(kernel.span_hashes(part, start, end), return_index=True, return_inverse=True)
                start, end = start[where], end[where]
                raw = part.tobytes()
                spelt = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
                crc = np.fromiter(map(zlib.crc32, spelt), np.uint32, len(spelt))
                # Runs of a word in one text share their fate.
                pair, times = np.unique(np.repeat(np.arange(j - i), np.diff(at)) * len(spelt) + word, return_counts=True)
                doc, word = np.divmod(pair, len(spelt))
                prefix = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids[i:j]], np.uint32)
                h = crc_of_pairs(prefix[doc], crc[word], (end - start)[word])
                hit = np.flatnonzero(h % np.uint32(typo_every) == 0)
                whole = np.bincount(word, times, len(spelt)) - np.bincount(word[hit], times[hit], len(spelt))
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                kept = np.flatnonzero((whole > 0) & (points[end] - points[start] >= min_length))
                yield pa.RecordBatch.from_arrays([spans_array(part, start[kept], end[kept]), pa.array(whole[kept].astype(np.int64))], ["word", "n"])
                typos = []
                for w, k in zip(word[hit].tolist(), h[hit].tolist()):
                    full = spelt[w].decode()
                    k %= len(full)
                    typos.append((full[:k] + full[k + 1 :]).encode() if len(full) > min_length else None)
                yield pa.RecordBatch.from_arrays([pa.array(typos, pa.binary()), pa.array(times[hit])], ["word", "n"])
        kernel.trim()

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInArrow(count, "word binary, n long").filter(F.col("word").isNotNull())
    return found.groupBy("word").agg(F.sum("n").alias("n")).select(F.col("word").cast("string").alias("word"), "n")


def _blocks(rows: DataFrame) -> DataFrame:
    """The key of what a block's words share."""
    shared = (F.substring("word", F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.substring(F.col("word"), -F.col("b"), F.col("b"))).otherwise(""))
    return rows.withColumn("key", F.xxhash64("m", "path", *shared))


def _halves(rows: DataFrame) -> DataFrame:
    """Each word to the block with half of the open part more of its prefix, and to the one with as much more of its suffix."""
    g = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    prefix = F.struct(F.concat("path", F.lit("<")).alias("path"), (F.col("a") + g).alias("a"), F.col("b").alias("b"), F.col("cap").alias("cap"))
    suffix = F.struct(F.concat("path", F.lit(">")).alias("path"), F.col("a").alias("a"), (F.col("b") + g).alias("b"), F.least("cap", F.col("a") + g).alias("cap"))
    return _blocks(rows.select("word", "n", "m", F.explode(F.array(prefix, suffix)).alias("x")).select("word", "n", "m", "x.*"))


def _first_blocks(words: DataFrame) -> DataFrame:
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter("m > 0")
    return _halves(rows.select("word", "n", "m", F.lit("").alias("path"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(NO_CAP).alias("cap")))


def _pairs_within(sizes: np.ndarray, short: np.ndarray):
    """Blocks one behind the other, shorter words first: (i, j) of all pairs with a shorter word, in pieces."""
    start = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(sizes)), short)  # one row per shorter word
    first = start[block] + np.arange(len(block)) - np.repeat(np.cumsum(short) - short, short)
    partners = start[block] + sizes[block] - first - 1
    upto = np.cumsum(partners)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        n = partners[a:b]
        yield np.repeat(first[a:b], n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - first[a:b] - 1, n)
        a = b


def _common(points: np.ndarray, at_i: np.ndarray, at_j: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many code points agree from two places on, forwards or backwards, up to a limit."""
    n, open_ = np.zeros(len(limit), np.int64), np.flatnonzero(limit > 0)
    k = 0
    while len(open_):
        same = points[at_i[open_] + step * k] == points[at_j[open_] + step * k]
        n[open_[same]] += 1
        k += 1
        open_ = open_[same & (limit[open_] > k)]
    return n


def _verified(table: pa.Table):
    """(word, n, near, near_n), in both directions, of the near pairs in whole blocks."""
    number = {c: table.column(c).to_numpy() for c in ("key", "m", "a", "b", "cap", "size", "n")}
    m, a, b, cap, size, n = (number[c] for c in ("m", "a", "b", "cap", "size", "n"))
    changes = reduce(np.logical_or, [number[c][1:] != number[c][:-1] for c in ("key", "m", "a", "b", "cap")])
    edges = np.concatenate([[0], np.flatnonzero(changes) + 1, [len(m)]])
    sizes = np.diff(edges)
    short = np.add.reduceat((size == m).astype(np.int64), edges[:-1])
    text = table.column("word").to_pylist()
    points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    end = np.cumsum(size).astype(np.int64)
    start = end - size
    word = table.column("word").combine_chunks()
    for i, j in _pairs_within(sizes, short):
        shorter = m[i].astype(np.int64)
        left = _common(points, start[i], start[j], shorter, 1)
        right = _common(points, end[i] - 1, end[j] - 1, shorter, -1)
        near = (left + right >= np.where(size[j] > shorter, shorter, shorter - 1)) & (left < cap[i]) & (left >= a[i]) & (right >= b[i])
        i, j = i[near], j[near]
        p, q = np.concatenate([i, j]), np.concatenate([j, i])
        yield from pa.table({"word": word.take(pa.array(p)), "near": word.take(pa.array(q)), "near_n": n[q]}).to_batches()


def near_words(words: DataFrame, space: Workspace, block: int = BLOCK) -> DataFrame:
    """word, near, near_n for every ordered pair of the distinct words that are one edit apart."""
    settled, rows, level = [], space.save(_first_blocks(words), "blocks-0"), 0
    while True:
        # Open blocks of one place can't be parted further, and hold an alphabet's worth of words.
        large = rows.filter("m - a - b > 1").groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > block).select("key")
        large = space.save(large, f"large-{level}")
        if large.isEmpty():
            break
        settled.append(rows.join(large, "key", "left_anti"))
        level += 1
        rows = space.save(_halves(rows.join(large, "key", "left_semi")), f"blocks-{level}")
    every = reduce(DataFrame.unionByName, [*settled, rows]).withColumn("size", F.char_length("word"))
    return runs.by_sorted_key(every, "key", ["m", "a", "b", "cap", "size", "word"], _verified, "word string, near string, near_n long")


def follow(forms: DataFrame, space: Workspace) -> DataFrame:
    """(word, form) to (word, root): each round doubles the steps; forms grow in number, so there is no circle."""
    rows, i = space.save(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = rows.select(F.col("word").alias("root"), F.col("root").alias("further"))
        i += 1
        rows = space.save(rows.select("word", "root").join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{i}")
        if rows.filter("moved").isEmpty():
            return rows.select("word", "root")


def spelling_variants(docs: DataFrame, typo_every: int = 199, min_length: int = 6, min_count: int = 5, ratio: int = 5, block: int = BLOCK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per word of ``min_length`` code points and ``min_count`` uses: word, form, root, n, n_near, form_n."""
    space = Workspace(docs.sparkSession, "spelling")
    words = space.save(word_counts(docs, typo_every, min_length, text, doc_id).filter(F.col("n") >= min_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words, space, block).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word", "left")
    top = -F.col("best.less")
    formed: Column = top >= ratio * F.col("n")
    rows = rows.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, top).alias("form_n"))
    rows = space.save(rows, "forms")
    roots = follow(rows.filter(F.col("form").isNotNull()), space)
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH RECURSIVE {_CRC.strip()},
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
p AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {crc_sql("doc_id || ':' || run")} AS h FROM p, crc_table),
w AS (SELECT word, sum(n)::BIGINT AS n
      FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
d AS (SELECT DISTINCT c.word AS a, w.word AS b FROM c JOIN w ON c.less = w.word),
e AS (SELECT c.word AS a, o.word AS b FROM c JOIN c AS o ON c.hole = o.hole AND c.word <> o.word UNION ALL SELECT a, b FROM d UNION ALL SELECT b, a FROM d),
f AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS best, max(n) AS best_n FROM e JOIN w ON b = w.word GROUP BY a),
g AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
      FROM w LEFT JOIN f USING (word)),
k(word, root) AS (SELECT word, word FROM g UNION ALL SELECT k.word, g.form FROM k JOIN g ON k.root = g.word WHERE g.form IS NOT NULL)
SELECT g.word, g.form, k.root, g.n, g.n_near, g.form_n
FROM g JOIN k ON g.word = k.word JOIN g AS t ON k.root = t.word WHERE t.form IS NULL
"""
