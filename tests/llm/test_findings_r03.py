"""Cases of the third round's findings on the corpus operators."""

import random
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("pyspark")

from evidentia.llm import ngram_jaccard  # noqa: E402

from .test_operators import brute_jaccard, noisy  # noqa: E402


def test_jaccard_keeps_no_wide_table(spark):
    """what was only needed on the way is freed, so the disk doesn't hold the routing shingles and the texts' sets to the end."""
    df = spark.createDataFrame(noisy(60), "doc_id long, text string")
    found = ngram_jaccard.jaccard_components(df, 4, 85)
    root = max(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("jaccard-*"), key=lambda p: p.stat().st_mtime)
    wide = {p.name for p in root.iterdir() if {"keys", "tokens"} & set(spark.read.parquet(str(p)).columns)}
    assert not wide and found.count() == 60


def test_only_near_pairs_meet_pivots(spark, monkeypatch):
    """members of a large group meet a pivot's set only if their bitmaps allow a link."""
    monkeypatch.setattr(ngram_jaccard, "PIVOTS", 3)
    r = random.Random(1)
    docs = [(i, "a b c d " + " ".join(f"w{r.randrange(10**6)}" for _ in range(40))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bits = ngram_jaccard.sketches(df, "doc_id", "text", 4, 85, np.zeros(ngram_jaccard.BLOOM_BITS, bool)).select("id", "n", "bits")
    large = bits.selectExpr("1L AS gid", "id", "cast(n AS long) AS n")
    assert ngram_jaccard.pivot_pairs(large, bits, 85).count() == 0


@pytest.mark.parametrize("rows", [0, 1 << 19])
@pytest.mark.parametrize("block", [4, 2048])
def test_jaccard_reads_texts_again_whole(spark, monkeypatch, rows, block):
    """texts of candidates, dealt out or met by broadcast, with ids that repeat."""
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(ngram_jaccard, "GROUP_BLOCK", block)
    base = " ".join(f"w{k}" for k in range(50))
    docs = [(i, base + f" x{i % 7}") for i in range(30)] + [(3, base + " x3"), (3, "other words stand here now"), (5, base + " y")] + [(100 + i, t) for i, t in noisy(40) if i is not None]
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4, 85).collect()}
    assert got == {(i, c) for i, _, c in brute_jaccard(docs, 4, 85)}


def test_plain_words_need_no_pattern(monkeypatch):
    """op13 over its CPU budget: words of letters alone, most of the new ones, aren't split by the pattern; their ids are tiktoken's."""
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from evidentia.llm.byte_bpe import BytePairs, read_ranks, vocabulary_path

    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    pairs = BytePairs(path, tokenizers.PATTERN)
    theirs = tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    r = random.Random(3)
    made = ["".join(r.choice("etaoinshrdluAEé'1ß") for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    split, asked = pairs._split, []
    monkeypatch.setattr(pairs, "_split", lambda chunk: asked.append(chunk) or split(chunk))
    for texts in ([" ".join(made)], ["x's don't it'll", " a", "a", " ", "", "B2b é́ ", "Ünïcode  two\n\nlines"], made):
        assert [np.frombuffer(x, "<u4").tolist() for x in pairs.encode(texts)] == [theirs.encode_ordinary(x) for x in texts]
    assert not [c for c in asked if c.isascii() and c.strip(" ").isalpha() and not c.startswith("  ") and not c.endswith(" ")]
