"""The queries of this package and their SQL, for the entry module."""

from __future__ import annotations

from fernhill.llm import bpe, centroids, decontamination, language_id, line_dedup, near_duplicates, packing, quality, substring_dedup, suffix_dedup, token_output, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_token_output": token_output.op2_token_output,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_jaccard_join": near_duplicates.op7_jaccard_join,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_bpe": bpe.op11_bpe,
        "op12_centroids": centroids.op12_centroids,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict:
    return {
        "op5_substring_dedup": substring_dedup.ORACLE_SQL,
        "op7_jaccard_join": near_duplicates.ORACLE_SQL,
        "op10_line_dedup": line_dedup.ORACLE_SQL,
        "op12_centroids": centroids.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
