"""Language-model scoring by the marginal likelihood of subword lattices.

A word is generated either whole, with its share among the training words, or
piece by piece from an existing subword vocabulary; the piece route adds up all
segmentations of the word by a forward recursion in log space. The vocabulary's
scores give the pieces' first probabilities, which EM rounds over the counted
training words adapt. The weight of the piece route is the share of words seen
once (Good-Turing), so unseen words keep a sensible probability.

All counts are exact and cover the whole corpus: every task counts its distinct
words, a shuffle adds them up. Documents look up the most frequent words in a
table of at most ``FREQUENT`` entries; their other words meet the counts in a
join, so neither hot words nor the size of the vocabulary end up in one task.

Defined results: a null or blank text is one end token; a null id is trained on;
rows that repeat an id are further documents; an empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel
from .workspace import Workspace

U = np.uint64
FREQUENT = 1 << 18
EM_ROUNDS = 4
CELLS = 1 << 20  # bytes of words that go through the lattice at once
LONG_WORD = 256  # bytes: longer words go through on their own, in stretches of STRETCH bytes
STRETCH = 1 << 16
SLICE = 4_000_000
_STEP = U(0x9E3779B97F4A7C15)


def vocabulary_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Lower-case pieces (a leading space marks a word's start) and probabilities by the vocabulary's own ranking."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): 1e-7 for b in range(256) if b not in (9, 10, 11, 12, 13)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:] and not any(65 <= c <= 90 for c in piece):
            found[piece] = 1.0 / (100.0 - model.get_score(i))
    pieces = sorted(found)
    p = np.array([found[x] for x in pieces])
    return pieces, p / p.sum()


def _extend(h, byte):
    return (h ^ kernel._BYTE[byte]) * _STEP


class Lattice:
    """Forward and backward sums over all segmentations of many words at once."""

    def __init__(self, pieces: list[bytes], p: np.ndarray):
        hashes = []
        for x in pieces:
            h = np.zeros(1, np.uint64)
            for b in x:
                h = _extend(h, b)
            hashes.append(h[0])
        order = np.argsort(np.array(hashes, np.uint64))
        self.hashes, self.ids = np.array(hashes, np.uint64)[order], order
        self.logp = np.log(np.maximum(p, 1e-300))
        self.longest = max(map(len, pieces))

    def edges(self, m: np.ndarray):
        """(from, to, which words, piece numbers) for words of one length, as rows of bytes, by rising start."""
        n, length = m.shape
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = _extend(h, m[:, j])
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                rows = np.flatnonzero(self.hashes[at] == h)
                if len(rows):
                    yield i, j + 1, rows, self.ids[at[rows]]

    def long_edges(self, word: np.ndarray, a: int, b: int):
        """(from, to, piece numbers) of one word's pieces that start in a .. b-1, by rising start."""
        found, h = [], np.zeros(b - a, np.uint64)
        for size in range(1, self.longest + 1):
            n = min(b, len(word) - size + 1) - a
            if n <= 0:
                break
            h = _extend(h[:n], word[a + size - 1 : a + size - 1 + n])
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            found.append((hit + a, hit + a + size, self.ids[at[hit]]))
        start, end, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(start, kind="stable")
        return start[order], end[order], ids[order]

    def long_forward(self, word: np.ndarray) -> np.ndarray:
        """Log sums over all segmentations up to each place of one word: linear in its length."""
        alpha = [-math.inf] * (len(word) + 1)
        alpha[0] = 0.0
        for a in range(0, len(word), STRETCH):
            start, end, ids = self.long_edges(word, a, min(a + STRETCH, len(word)))
            for i, j, p in zip(start.tolist(), end.tolist(), self.logp[ids].tolist()):
                alpha[j] = _log_add(alpha[j], alpha[i] + p)
        return np.array(alpha)

    def long_expected(self, word: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one word."""
        alpha, out = self.long_forward(word), np.zeros(len(self.logp))
        beta = [-math.inf] * (len(word) + 1)
        beta[len(word)] = 0.0
        for a in range((len(word) - 1) // STRETCH * STRETCH, -1, -STRETCH):
            start, end, ids = self.long_edges(word, a, min(a + STRETCH, len(word)))
            for i, j, p in zip(reversed(start.tolist()), reversed(end.tolist()), reversed(self.logp[ids].tolist())):
                beta[i] = _log_add(beta[i], beta[j] + p)
            np.add.at(out, ids, np.exp(alpha[start] + self.logp[ids] + np.array([beta[j] for j in end.tolist()]) - alpha[-1]))
        return out

    def forward(self, m: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log sums over all segmentations of each word."""
        n, length = m.shape
        if length > LONG_WORD:
            return np.array([self.long_forward(w)[-1] for w in m])
        return self._alpha(m, keep)[length]

    def _alpha(self, m: np.ndarray, keep: list | None = None) -> np.ndarray:
        n, length = m.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, ids in self.edges(m):
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.logp[ids])
            if keep is not None:
                keep.append((i, j, rows, ids))
        return alpha

    def expected(self, m: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, each word counted once."""
        if m.shape[1] > LONG_WORD:
            return sum(self.long_expected(w) for w in m)
        kept: list = []
        alpha = self._alpha(m, kept)
        length, n = m.shape[1], len(m)
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0.0
        out = np.zeros(len(self.logp))
        for i, j, rows, ids in reversed(kept):  # by falling start: what follows j is complete
            after = beta[j, rows] + self.logp[ids]
            beta[i, rows] = np.logaddexp(beta[i, rows], after)
            np.add.at(out, ids, np.exp(alpha[i, rows] + after - alpha[length, rows]))
        return out


def _log_add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _by_length(column: pa.Array):
    """(rows, byte matrix) per word length; a space stands before each word."""
    data = column.cast(pa.large_binary())
    offs = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    length = np.diff(offs)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        step = max(1, min(20_000, CELLS // (int(n) + 1)))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield part, np.concatenate([np.full((len(part), 1), 32, np.uint8), raw[offs[part][:, None] + np.arange(n)]], axis=1)


def spans_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte spans as an Arrow binary column."""
    length = end - start
    stop = np.cumsum(length)
    flat = data[np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - length - start, length)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate([[0], stop]).astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def word_types(docs: DataFrame) -> DataFrame:
    """(held, text) rows to every distinct lower-cased word with its count in training and in all texts."""

    def count(batches):
        for batch in batches:
            data, offs = kernel.as_bytes(batch.column("text"))
            train = ~batch.column("held").to_numpy(zero_copy_only=False)
            for i, j in kernel.slices(offs, SLICE):
                part = kernel.LOWER[data[offs[i] : offs[j]]]
                start, end, at = kernel.words(part, offs[i : j + 1] - offs[i])
                if not len(start):
                    continue
                h, where, back = np.unique(kernel.span_hashes(part, start, end), return_index=True, return_inverse=True)
                used = np.repeat(train[i:j], np.diff(at))
                c = np.bincount(back, used.astype(np.float64), len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(np.bincount(back, minlength=len(h))), spans_array(part, start[where], end[where])], ["h", "c", "c_all", "word"])

    rows = docs.mapInArrow(count, "h long, c long, c_all long, word binary")
    return rows.groupBy("h").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"), F.min("word").alias("word"))


def lm_scores(docs: DataFrame, held_out, vocabulary: str, doc_id: str = "doc_id", text: str = "text", em_rounds: int = EM_ROUNDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score. held_out: a boolean column, not learnt from."""
    spark = docs.sparkSession
    space = Workspace(spark, "lm")
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    types = space.save(word_types(rows.select("held", "text")), "types")
    ends = rows.filter(~F.col("held")).count()
    total = types.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    n = (total.n or 0) + ends
    v = (total.v or 0) + (ends > 0)
    base_total = n + 0.5 * (v + 1)
    p_end = (ends + 0.5) / base_total

    pieces, p = vocabulary_pieces(vocabulary)
    for _ in range(em_rounds if total.n else 0):
        lattice = Lattice(pieces, p)

        def expect(batches, lattice=lattice):
            out = np.zeros(len(lattice.logp))
            for batch in batches:
                for at, m in _by_length(batch.column("word")):  # each distinct word counts once: the pieces are for new words
                    out += lattice.expected(m)
            used = np.flatnonzero(out > 0)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used])], ["piece", "uses"])

        learnt = types.filter("c > 0").select("word").mapInArrow(expect, "piece long, uses double")
        uses = np.full(len(pieces), 0.01)
        for row in learnt.groupBy("piece").agg(F.sum("uses").alias("uses")).toLocalIterator():  # a row per piece of the vocabulary at most
            uses[row.piece] += round(row.uses, 6)
        p = uses / uses.sum()
    lattice = Lattice(pieces, p)
    unseen = min(max((total.once or 0) / n, 1e-6), 0.5) if n else 1.0  # the weight of the piece route
    by_pieces = np.log(unseen) + np.log1p(-min(p_end, 1 - 1e-12))  # sums to 1 over all words as it is: a word ends where the next piece begins with a space

    def score(batches):
        for batch in batches:
            c = batch.column("c").to_numpy()
            out = np.zeros(len(c))
            with np.errstate(divide="ignore"):
                whole = np.log(c * (1 - unseen) / max(n, 1))
            for at, m in _by_length(batch.column("word")):
                out[at] = np.logaddexp(whole[at], by_pieces + lattice.forward(m))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), batch.column("c_all"), pa.array(out / np.log(10))], ["h", "c", "c_all", "logp"])

    types = space.save(types.mapInArrow(score, "h long, c long, c_all long, logp double"), "scored")

    # The frequent words: counts of words by size class say which counts make at most FREQUENT words.
    size_class = F.floor(F.log2(F.col("c_all").cast("double")) * 8)
    least, have = None, 0
    for row in types.groupBy(size_class.alias("k")).count().orderBy(F.desc("k")).collect():  # at most 8 * 64 rows
        have += row["count"]
        if have > FREQUENT:
            break
        least = row.k
    often = types.filter(size_class >= least).select("h", "c", "logp").toPandas() if least is not None else None
    if often is None:
        fh, fc, fl = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    else:
        often = often.sort_values("h")
        fh, fc, fl = often.h.to_numpy(), often.c.to_numpy(), often.logp.to_numpy()
    log_total, end_base = np.log10(base_total), np.log10(p_end)

    def look_up(batches):
        for batch in batches:
            data, offs = kernel.as_bytes(batch.column("text"))
            for i, j in kernel.slices(offs):
                h, at = kernel.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                h = h.view(np.int64)
                doc = np.repeat(np.arange(j - i), np.diff(at))
                place = np.minimum(np.searchsorted(fh, h), max(len(fh) - 1, 0))
                hit = fh[place] == h if len(fh) else np.zeros(len(h), bool)
                q, d = place[hit], doc[hit]
                base = np.bincount(d, np.log10(fc[q] + 0.5) - log_total, j - i) + end_base
                rare = h[~hit]
                lengths = np.bincount(doc[~hit], minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), batch.column("id").slice(i, j - i), batch.column("held").slice(i, j - i), pa.array(np.diff(at) + 1), pa.array(np.bincount(d, fc[q] > 0, j - i).astype(np.int64) + (ends > 0)), pa.array(base), pa.array(np.bincount(d, fl[q], j - i) + end_base), kernel.lists(rare, np.concatenate([[0], np.cumsum(lengths)]))],
                    ["row", "id", "held", "n_tokens", "known", "base", "logp", "rare"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    part = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(look_up, f"row long, id {kind}, held boolean, n_tokens long, known long, base double, logp double, rare array<long>")
    part = space.save(part, "documents")
    space.release()
    met = part.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times")).join(types.select("h", "c", F.col("logp").alias("w_logp")), "h")
    w = F.col("times")
    met = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, w).otherwise(0)).alias("r_known"),
        F.sum(w * (F.log10(F.col("c") + 0.5) - float(log_total))).alias("r_base"),
        F.sum(w * F.col("w_logp")).alias("r_logp"),
    )
    out = part.drop("rare").join(met, "row", "left")
    zero = F.lit(0)
    return out.select(
        F.col("id").alias(doc_id), F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("r_known", zero)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"),
        (F.col("logp") + F.coalesce("r_logp", F.lit(0.0))).alias("score"),
    )


def crc_fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def op8_lattice_lm(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, crc_fold() == 1, public_tokenizers.path("piece_bpe_32k.model"))
