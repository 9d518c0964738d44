"""Named queries over the given tables, one for each operator, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themeloom.llm import byte_bpe, decontamination, embedding_dedup, licenses, lm_scoring, packing, quality_classifier, quality_rules, sharding, simhash, spelling, token_files, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_attention_lm": lm_scoring.op3_attention_lm,
    "op4_lattice_dedup": embedding_dedup.op4_lattice_dedup,
    "op5_token_file": token_files.op5_token_file,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_knn_quality": quality_classifier.op7_knn_quality,
    "op8_sharding": sharding.op8_sharding,
    "op9_packing": packing.op9_packing,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_suffix_automaton": decontamination.op12_suffix_automaton,
    "op13_whitening": whitening.op13_whitening,
}


def oracles() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op6_quality_rules": quality_rules.ORACLE, "op12_suffix_automaton": decontamination.ORACLE}
