"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import decontaminate, hard_negatives, html_extract, lexical, licenses, minhash, packing, pii, pitman_yor, quality, simhash, suffix_dedup, token_tree


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus; corpus_pipeline.py is at the top of the repository."""
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op6_licenses": licenses.op6_licenses,
    "op3_token_counts": token_tree.op3_token_counts,
    "op10_pitman_yor": pitman_yor.op10_pitman_yor,
    "pipeline": pipeline,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op1_html": html_extract.op1_html,
    "op4_quality": quality.op4_quality,
    "op2_pii": pii.op2_pii,
    "op7_minhash": minhash.op7_minhash,
    "op5_simhash": simhash.op5_simhash,
    "op9_packing": packing.op9_packing,
}

#: Only what SQL can express on whole tables; the others are tested against plain restatements in tests/llm.
ORACLES: dict[str, str] = {"op7_minhash": minhash.ORACLE_SQL, "op11_lexical_search": lexical.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL}
