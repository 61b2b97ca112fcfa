"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the set of its words, word pairs, and pairs with one word
between (lower-cased, outer ASCII punctuation off), hashed into 2^20 places. FTRL
with per-coordinate rates and L1 leaves a sparse weight vector, which goes to all
tasks; its size is bounded by the number of places.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows (all of them, or
those with the smallest hashed ids); every text is scored whole.

Defined results: a null or empty text has no feature and gets the bias's score; a
null label or id is not learnt from; a document with several labels counts as
toxic if one says so; without labels of both kinds all scores are the share of
toxic rows, or 0; rows that repeat an id are all scored; an empty table gives an
empty table. Columns besides id and text never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel
from .lattice_lm import crc_fold

U = np.uint64
PLACES = 1 << 20
TRAIN_ROWS = 16_384
EPOCHS, ALPHA, BETA, L1, L2, MIN_DOCS, SEED = 5, 0.5, 1.0, 6.0, 0.1, 2, 11
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of all features, repeats included."""
    data = kernel.LOWER[data]
    start, end, at = kernel.words(data, offs)
    for _ in range(4):
        end = end - (PUNCTUATION[data[end - 1]] & (end - start > 1)) if len(end) else end
        start = start + (PUNCTUATION[data[start]] & (end - start > 1)) if len(end) else start
    w = kernel.span_hashes(data, start, end)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    docs, out = [doc], [kernel.mix(w + U(1))]
    for gap, salt in ((1, 2), (2, 3)):
        if len(w) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            out.append(kernel.mix(w[:-gap][same] * U(0x9FB21C651E98DF25) + w[gap:][same] + U(salt)))
    return np.concatenate(docs), (np.concatenate(out) & U(PLACES - 1)).astype(np.int64)


def distinct(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * PLACES + place)
    return both // PLACES, both % PLACES


class Ftrl:
    """FTRL-proximal: z and n per coordinate, weights made on demand. Place PLACES is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == PLACES, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that L1 left; the bias is set where the sample's two kinds part best."""
    times = np.zeros(PLACES + 1, np.int64)
    for at, _ in rows:
        times[at] += 1
    rows = [(at[times[at] >= MIN_DOCS], y) for at, y in rows]
    model, rng = Ftrl(), np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            model.learn(*rows[k])
    w = model.weights(np.arange(PLACES + 1))
    margins, y = np.array([w[at].sum() for at, _ in rows]), np.array([y for _, y in rows])
    order = np.argsort(margins, kind="stable")
    wrong = (y == 0).sum() + np.concatenate([[0], np.cumsum(np.where(y[order] == 1, 1, -1))])  # with the first k called clean
    k = int(np.argmin(wrong))
    w[PLACES] -= (margins[order][max(k - 1, 0)] + margins[order][min(k, len(rows) - 1)]) / 2
    at = np.flatnonzero(w)
    return at, w[at]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(place, weight) of the fitted model. docs and labels hold only what may be learnt from."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(known, "id")
    n = docs.select(F.col(doc_id).alias("id")).join(known, "id", "left_semi").count()
    order = F.xxhash64(F.lit(SEED), "id")
    if n > TRAIN_ROWS:  # the smallest hashes; the share is set a little low to stay within the bound
        rows = rows.filter(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * 0.97 * TRAIN_ROWS / n))

    def hashed(batches):
        for batch in batches:
            data, offs = kernel.as_bytes(batch.column("text"))
            for i, j in kernel.slices(offs):
                doc, place = distinct(*features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                yield pa.RecordBatch.from_arrays([batch.column("order").slice(i, j - i), batch.column("y").slice(i, j - i), kernel.lists(place.astype(np.int32), np.searchsorted(doc, np.arange(j - i + 1)))], ["order", "y", "places"])

    def learn(batches):
        rows = []
        for batch in batches:
            flat, at = batch.column("places").values.to_numpy(), batch.column("places").offsets.to_numpy()
            for k, y in enumerate(batch.column("y").to_pylist()):
                rows.append((np.append(flat[at[k] : at[k + 1]], np.int32(PLACES)), y))
        seen = {y for _, y in rows}
        if len(seen) < 2:
            at, w = np.array([PLACES]), np.array([35.0 if seen == {1} else -35.0])
        else:
            at, w = fit(rows)
        del rows
        kernel.trim()
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["place", "weight"])

    # One task fits: its input is the bounded sample.
    sample = rows.select(order.alias("order"), "y", "text").mapInArrow(hashed, "order long, y int, places array<int>")
    return sample.repartition(1).sortWithinPartitions("order", "y", "places").mapInArrow(learn, "place long, weight double")


def _scorer(model: DataFrame):
    """A function from a text column to scores, for use inside tasks."""
    weights = np.zeros(PLACES + 1, np.float32)
    for r in model.toLocalIterator():  # at most PLACES + 1 rows
        weights[r.place] = r.weight
    if not weights.any():
        weights[PLACES] = -35.0  # nothing to learn from: no text is toxic
    at = np.flatnonzero(weights)
    places, values = at.astype(np.int32), weights[at]

    def of_texts():
        w = np.zeros(PLACES + 1, np.float32)
        w[places] = values

        def scores(column: pa.Array) -> np.ndarray:
            data, offs = kernel.as_bytes(column)
            out = np.zeros(len(offs) - 1)
            for i, j in kernel.slices(offs):
                doc, place = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                used = w[place] != 0
                doc, place = distinct(doc[used], place[used])
                out[i:j] = np.bincount(doc, w[place].astype(np.float64), j - i) + w[PLACES]
            return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

        return scores

    return of_texts


def score(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, score, predicted."""
    of_texts = _scorer(model)

    def work(batches):
        scores = of_texts()
        for batch in batches:
            p = scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [doc_id, "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """The rows that score below 0.5, with all their columns; nothing is shuffled."""
    of_texts = _scorer(model)

    def work(batches):
        scores = of_texts()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text)) < 0.5))
        kernel.trim()

    return docs.mapInArrow(work, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.filter(crc_fold() != 0))
    return score(docs, model).select("doc_id", (crc_fold() == 0).alias("held_out"), "score", "predicted")
