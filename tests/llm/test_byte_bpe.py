"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest

from evidentia.llm import byte_bpe
from evidentia.llm.shipping import ship
from evidentia.llm.token_files import vocabulary_path

from .conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pairs():
    return byte_bpe.BytePairs(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference(pairs):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    return lambda text: np.array(library.encode_ordinary(text or ""), "<u4").tobytes()


def texts():
    r = random.Random(5)
    yield from [None, "", "   ", " a", "a  b \n c\t\t", "don't  we'll 'S", "\x00\x01 \x1c a\x85b", "漢字" * 90, "😀" * 30, "՘a՘֋1 ֋!", "a\n\n b  ", ">>>>" * 60, " " * 3000 + "x", "x " * 9]
    yield from ("".join(r.choice("ab \n's1é!漢　") for _ in range(r.randint(0, 300))) for _ in range(80))
    valid = [*range(0xD800), *range(0xE000, 0x110000)]
    yield from ("".join(chr(r.choice(valid)) if r.random() < 0.5 else chr(r.randrange(0x3000)) for _ in range(100)) for _ in range(30))
    yield from ("".join(r.choice("abcdefghijklmnop") for _ in range(n)) for n in (255, 256, 257, 4000))  # both sides of LONG_WORD


def test_ids_are_the_librarys(pairs, reference):
    every = list(texts())
    found = pairs.encode(every)
    assert found == [reference(t) for t in every]
    assert pairs.decode(found) == [(t or "").encode() for t in every]


def test_small_blocks_and_forgetting_change_nothing(pairs, reference, monkeypatch):
    every = list(texts())
    for name, value in (("RECURSION_ROWS", 50), ("CACHE", 20), ("STRETCH", 64), ("LONG_WORD", 12)):
        monkeypatch.setattr(byte_bpe, name, value)
    fresh = byte_bpe.BytePairs(PATH, PATTERN)
    assert fresh.encode(every) == [reference(t) for t in every]
    assert fresh.decode([reference(t) for t in every]) == [(t or "").encode() for t in every]


def test_recursion_contracts_the_leftmost_minimum(tmp_path):
    """Ranks where the order matters: equal pairs, and a later merge of lower rank."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"aab", b"ab", b"aa", b"abab", b"bab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    pairs = byte_bpe.BytePairs(str(path), r"[ab]+|.")
    ranks = {t: i for i, t in enumerate(tokens)}

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            options = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if word in ranks:
                return [ranks[word]]
            if not options:
                break
            _, i = min(options)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    words = ["".join("ab"[n >> k & 1] for k in range(length)) for length in range(1, 11) for n in range(1 << length)]
    assert [np.frombuffer(x, "<u4").tolist() for x in pairs.encode(words)] == [plain(w.encode()) for w in words]
    assert all(np.frombuffer(pairs.contract_long(w.encode()), "<u4").tolist() == plain(w.encode()) for w in words if w.encode() not in ranks)


def test_unknown_ids_are_refused(pairs):
    with pytest.raises(ValueError):
        pairs.decode([np.array([50_256], "<u4").tobytes()])


def test_documents(spark, odd, none, reference):
    ship(spark)
    want = sorted((str(i), reference(t), (t or "").encode()) for i, t, _ in ODD)
    rows = byte_bpe.round_trip(odd, PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.packed), bytes(r.decoded)) for r in rows) == want
    in_two = byte_bpe.decode(byte_bpe.encode(odd, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.packed), bytes(r.decoded)) for r in in_two) == want
    assert byte_bpe.round_trip(none, PATH, PATTERN).count() == 0
    named = odd.selectExpr("cast(doc_id AS string) AS packed", "text AS decoded")
    assert byte_bpe.encode(named, PATH, PATTERN, "decoded", "packed").count() == len(want)


def test_query(spark, reference):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (len(reference(r.text)) // 4, hashlib.sha256(reference(r.text)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs}
    found = byte_bpe.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == want and len(found) == len(docs)
