"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import byte_bpe, decontamination, lattice_lm, line_dedup, mixing, ngram_jaccard, ngram_resampling, pii, rp_forest, spelling_variants, suffix_dedup, token_files, toxicity
from .shipping import ship

QUERIES = {
    "op1_decontaminate": decontamination.op1_decontaminate,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_files": token_files.op3_token_files,
    "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op5_embedding_forest": rp_forest.op5_embedding_forest,
    "op7_pii_pseudonyms": pii.op7_pii_pseudonyms,
    "op8_lattice_lm": lattice_lm.op8_lattice_lm,
    "op9_toxicity": toxicity.op9_toxicity,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op11_importance_resampling": ngram_resampling.op11_importance_resampling,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}


def _with_package(query: Callable) -> Callable:
    def run(spark, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _with_package(query) for name, query in QUERIES.items()}

ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_ngram_jaccard": ngram_jaccard.ORACLE,
    "op5_embedding_forest": rp_forest.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op11_importance_resampling": ngram_resampling.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
}
