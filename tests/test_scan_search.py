"""Scans against every pair: exact scores, ties by id, and bounds that skip postings but lose nothing."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from evidentia.functions.text import STOPWORDS
from evidentia.operators import scan_search as S


def ranked(pairs, k):
    """(query, id, score) to the k best of each query."""
    out = set()
    by = {}
    for q, i, s in pairs:
        by.setdefault(q, []).append((-s, i))
    for q, xs in by.items():
        out |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(xs)[:k], 1)}
    return out


@pytest.mark.parametrize("query_bytes", [32 << 20, 200])
def test_dense(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(S, "QUERY_BYTES", query_bytes)
    g = np.random.Generator(np.random.PCG64(1))
    rows = [(i, [float(x) for x in g.integers(-2, 3, 5)], ["a", "b", None][i % 3]) for i in range(90)]
    rows += [(100, None, "a"), (101, [0.0] * 5, "a"), (102, [1.0, float("nan"), 0.0, 0.0, 0.0], "a"), (103, [1.0, 2.0], "a")]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<double>, label string").repartition(3)
    good = [(i, np.array(v), s) for i, v, s in rows if v and len(v) == 5 and np.isfinite(v).all() and any(v)]
    q = df.filter("chunk_id % 9 = 0").selectExpr("chunk_id AS query_id", "vector AS query_vector", "label")
    cos = lambda a, b: round(float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b))), 9)
    got = {(r.query_id, r.chunk_id, r.rank) for r in S.dense_scan(q, df, 7).collect()}
    assert got == ranked([(i, j, cos(a, b)) for i, a, _ in good if i % 9 == 0 for j, b, _ in good], 7)
    got = {(r.query_id, r.chunk_id, r.rank) for r in S.dense_scan(q, df, 7, "label").collect()}
    assert got == ranked([(i, j, cos(a, b)) for i, a, s in good if i % 9 == 0 for j, b, z in good if s is not None and s == z], 7)


def texts(n, seed=2):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 4))) for _ in range(80)] + ["the", "of"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    return [(i, " ".join(r.choices(pool, weights, k=r.choice([0, 3, 10, 80, 400]))) + r.choice(["", "!"])) for i in range(n)] + [(n, None)]


def plain_weights(text):
    c = Counter(w for w in "".join(x if x.isascii() and x.isalnum() else " " for x in (text or "").lower()).split() if w not in STOPWORDS)
    return {w: f * 2.5 / (f + 1.5) for w, f in c.items()}


@pytest.mark.parametrize("query_bytes,block", [(32 << 20, 32), (600, 4)])
def test_sparse(spark, monkeypatch, query_bytes, block):
    monkeypatch.setattr(S, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(S, "BLOCK_DOCS", block)
    rows = texts(200)
    df = spark.createDataFrame(rows, "chunk_id long, content string").repartition(3)
    q = df.filter("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "content AS text")
    w = {i: plain_weights(t) for i, t in rows}
    pairs = [(i, j, round(sum(a[t] * b[t] for t in a.keys() & b.keys()), 6)) for i, a in w.items() if i % 20 == 0 for j, b in w.items() if a.keys() & b.keys()]
    got = {(r.query_id, r.chunk_id, r.rank) for r in S.sparse_scan(q, df, 5).collect()}
    assert got == ranked(pairs, 5)
    counts = S.sparse_scan(q, df, 5, count_postings=True).collect()
    every = sum(len(w[i].keys() & b.keys()) for i in w if i % 20 == 0 for b in w.values())
    assert sum(int(r.score) for r in counts) == every and sum(r.chunk_id for r in counts) < every * 0.95


def test_nothing_to_search(spark):
    empty = spark.createDataFrame([], "chunk_id long, content string, vector array<double>")
    some = spark.createDataFrame([(1, "word", [1.0])], "chunk_id long, content string, vector array<double>")
    q = lambda df: df.selectExpr("chunk_id AS query_id", "content AS text", "vector AS query_vector")
    for a, b in ((empty, some), (some, empty), (empty, empty)):
        assert S.sparse_scan(q(a).select("query_id", "text"), b, 3).count() == 0 and S.dense_scan(q(a), b, 3).count() == 0
