"""Importance resampling against a plain version, for several longest n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import kernel, ngram_resampling as nr
from evidentia.llm.shipping import ship

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    w = WORD.findall((text or "").translate(UP))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, longest, buckets, percent, min_words, seed):
    of = lambda t: [zlib.crc32(f.encode()) % buckets for f in features(t, longest)[1]]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (ss + buckets)) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        weight = sum(gain[b] for b in of(x))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features(x, longest)[1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(x, longest)[0])])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0], -r[1], -r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted([(*r[:4], drawn.get(id(r))) for r in rows], key=str)


def noisy(n, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdeéÄ1") for _ in range(r.randint(1, 4))) for _ in range(60)]
    return [(i, "".join(r.choice(pool) + r.choice([" ", " ", ", ", "\n", "-"]) for _ in range(r.randint(0, 60))).swapcase()) for i in range(n)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize("longest,slice_bytes", [(1, 4_000_000), (2, 4_000_000), (3, 200)])
def test_resampling(spark, monkeypatch, longest, slice_bytes):
    monkeypatch.setattr(nr, "SLICE", slice_bytes)
    docs, target = noisy(120, 1) + [(i, t) for i, t, _ in ODD if i != 8], [t for _, t in noisy(20, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = nr.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest, 97, 30, 5, 7).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(docs, target, longest, 97, 30, 5, 7)


def test_suffix_array_runs():
    texts = ["a b a b", "b a", "", "A-b", "c", "é b é b é"]
    data, offs = kernel.as_bytes(pa.array(texts))
    for longest in (1, 2, 3):
        found, at = nr.buckets_of(data, offs, longest, 1 << 32)
        assert at.tolist() == [0, 4, 6, 6, 8, 9, 14]
        for k, (places, length, bucket) in enumerate(found, 1):
            got = Counter(dict(zip(bucket.tolist(), length.tolist())))
            want = Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) for t in texts for w in [features(t, 1)[0]] for i in range(len(w) - k + 1))
            assert got == want and len(bucket) == len(want)  # each distinct k-gram is one run
            assert len(set(places.tolist())) == len(places) == sum(length)


def test_long_prefixes_are_cut_at_longest():
    ids, text = np.zeros(50, np.int64), np.zeros(50, np.int64)
    order, lcp = nr.suffix_array(ids, text, 3)
    assert sorted(order.tolist()) == list(range(50)) and lcp.max() == 3


def test_odd_rows(spark, odd, none):
    got = nr.resample(odd, odd.select("text"), 2, 50, 50, 3)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.weight == 0 and r.rank is None for r in rows if r.doc_id in (3, 4, 5))
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, sum(r.rank is not None for r in rows) + 1))
    assert nr.resample(none, odd, 1, 50).count() == 0
    assert nr.resample(odd, none, 1, 50).count() == len(ODD)


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = nr.op11_importance_resampling(spark, "/root/testdata/sf0.001")
    want = con.sql(nr.ORACLE)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)
