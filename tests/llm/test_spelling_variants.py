"""Spelling variants against a plain version, with blocks of every size."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import kernel, spelling_variants as sv
from evidentia.llm.shipping import ship
from evidentia.llm.workspace import Workspace

from .conftest import ODD

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, typo_every, min_length, min_count, ratio):
    n = Counter()
    for i, t in docs:
        for w in RUN.findall(t or ""):
            w = w.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % typo_every == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def texts(seed, size):
    r = random.Random(seed)
    stems = ["internation", "relation", "étranger", "abcabcab", "zzzzzzzz", "straße", "naïveté"]
    pool = []
    for stem in stems:
        for _ in range(14):
            w = list(stem)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w))
                w[k : k + r.choice([0, 1])] = r.choice(["", "a", "é", "z", "qa"])
            pool.append("".join(w))
    weights = [r.choice([1, 2, 30, 200]) for _ in pool]
    return [(i, " ".join(w.upper() if r.random() < 0.2 else w for w in r.choices(pool, weights, k=r.randint(0, 60))) + r.choice(["", "!", "\n1a2b"])) for i in range(size)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.mark.parametrize("block,every,slice_bytes", [(128, 199, 4_000_000), (1, 7, 300), (4, 3, 4_000_000)])
def test_variants(spark, monkeypatch, block, every, slice_bytes):
    monkeypatch.setattr(sv, "SLICE", slice_bytes)
    monkeypatch.setattr(sv, "PAIRS", 5 if block == 4 else 1 << 18)
    docs = texts(block, 150) + [(i, t) for i, t, _ in ODD]
    want = plain(docs, every, 4, 2, 3)
    assert sum(r[1] is not None for r in want) > 10 and any(r[2] != r[1] and r[1] for r in want)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in sv.spelling_variants(df, every, 4, 2, 3, block).collect()) == want


@pytest.mark.parametrize("block", [1, 3, 128])
def test_every_pair_counts_once(spark, block):
    """All words of two letters and lengths 1 to 7: every block is skewed."""
    words = ["".join("ab"[n >> k & 1] for k in range(size)) for size in range(1, 8) for n in range(1 << size)]
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = [(r.word, r.near) for r in sv.near_words(df, Workspace(spark, "near"), block).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a != b and one_edit(a, b))


def test_a_hot_prefix_is_subdivided(spark):
    """3000 words of one prefix and one suffix end in blocks of bounded size."""
    r = random.Random(9)
    words = sorted({"prefixprefix" + "".join(r.choice("abcdefgh") for _ in range(6)) + "suffixsuffix" for _ in range(3000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    space = Workspace(spark, "hot")
    got = sorted((x.word, x.near) for x in sv.near_words(df, space, 64).collect())
    holes = {}
    for w in words:
        for k in range(12, 18):
            holes.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
    assert got == sorted((a, b) for ws in holes.values() for a in ws for b in ws if a != b)


def test_crc_of_pairs():
    r = random.Random(1)
    pairs = [(str(r.randrange(10**9)) + ":", "".join(r.choice("abcéÿ") for _ in range(r.randint(1, 90)))) for _ in range(500)]
    crc = lambda t: zlib.crc32(t.encode())
    got = sv.crc_of_pairs(np.array([crc(p) for p, _ in pairs], np.uint32), np.array([crc(w) for _, w in pairs], np.uint32), np.array([len(w.encode()) for _, w in pairs]))
    assert got.tolist() == [crc(p + w) for p, w in pairs]


def test_letter_runs():
    every = [t or "" for _, t, _ in ODD] + ["Ã©", "ÀÿĀaéŁ", "x×÷y", "ab", "cd", "éa"]
    data, offs = kernel.as_bytes(pa.array(every))
    start, end, at = sv.letter_runs(data, offs)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(start, end)] == [w for t in every for w in RUN.findall(t)]
    assert np.diff(at).tolist() == [len(RUN.findall(t)) for t in every]


def test_odd_rows(spark, odd, none):
    got = sv.spelling_variants(odd, 199, 3, 1, 2)
    assert sorted(tuple(r) for r in got.collect()) == plain([(i, t) for i, t, _ in ODD], 199, 3, 1, 2)
    assert sv.spelling_variants(none).count() == 0 and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    named = odd.selectExpr("doc_id AS word", "text AS key", "1 AS n")
    assert sv.spelling_variants(named, 199, 3, 1, 2, text="key", doc_id="word").count() == got.count()


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    df = sv.op12_spelling_variants(spark, "/root/testdata/sf0.001")
    want = con.sql(sv.ORACLE)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
