"""A training corpus from raw documents: five stages, each written and read again.

Each stage gets the rows its predecessor kept and returns the columns of
documents; the last one returns what the token files hold.

Defined results, as its operators have them: null and empty texts are documents (never toxic by their words, near to
nothing, without words in the mix, so they end there); of equal documents the smallest id stays, and rows without an id
are near to nothing; rows that repeat an id are documents each; columns besides doc_id, text and source pass through
all stages but the last (names that begin with two underscores are the stages' own); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import decontamination, mixing, ngram_jaccard, token_files, toxicity
from evidentia.llm.lattice_lm import crc_fold
from evidentia.llm.shipping import ship
from evidentia.llm.workspace import Workspace


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows outside the held-out fold."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(crc_fold() != 0)
    return toxicity.drop_toxic(docs, toxicity.train(docs.select("doc_id", "text"), labels))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest id stays."""
    ship(spark)
    return ngram_jaccard.one_per_component(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a test item go."""
    ship(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and per document what they hold."""
    ship(spark)
    path = Workspace(spark, "tokens").path("orc")
    token_files.write_token_files(docs, path, token_files.vocabulary_path("byte_bpe_50k.json"))
    return token_files.token_digests(spark, path)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

ORACLE_SQL = None  # a fitted classifier and a tokenizer are not SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return docs
