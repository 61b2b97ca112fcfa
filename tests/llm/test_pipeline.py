"""The pipeline's rows against a brute-force version on a small folder of tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from evidentia.llm import mixing, toxicity  # noqa: E402
from evidentia.llm.lattice_lm import crc_fold  # noqa: E402
from evidentia.llm.token_files import vocabulary_path  # noqa: E402

from .test_operators import brute_jaccard, noisy, words  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(9)
    items = [(k, " ".join(f"item{k}word{j}" for j in range(12))) for k in range(3)]
    docs = []
    for i, t in noisy(160):
        if i % 6 == 0:
            t = f"{t} vile awful"
        if i % 17 == 3:
            t = f"{t} {items[i % 3][1]}"
        docs.append((i, t, "en", r.choice(["s0", "s1", None]), len(t)))
    docs += [(900, None, "en", "s0", None), (901, "", None, "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_pipeline_rows(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").filter(crc_fold() != 0)
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs.select("doc_id", "text"), labels)).filter("predicted = 1").collect()}
    assert bad and all(i % 6 == 0 for i in bad)
    kept = sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad), key=lambda x: x[0])
    component = {i: c for i, _, c in brute_jaccard(kept, 5, 80)}
    kept = [(i, t) for i, t in kept if component[i] == i]
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not any(" ".join(w) in " ".join(words(t)) for w in items)]
    mixed = docs.filter(F.col("doc_id").isin([i for i, _ in kept]))
    times = {r.doc_id: round(r.taken / r.size) if r.size else 0 for r in mixing.mix(mixed).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in kept}
    want = Counter({(i, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())): n for i, n in times.items() if n})
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
