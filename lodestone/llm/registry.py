"""The subpackage's queries and their SQL."""

from __future__ import annotations

from lodestone.llm import decontaminate, exact_dedup, langid, lm_score, mixing, ngram_join, secrets, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_language_id": langid.op8_language_id,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_token_files": token_files.op10_token_files,
}

ORACLE_SQL = {
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_secret_scan": secrets.ORACLE_SQL,
    "op9_substring_dedup": substring_dedup.ORACLE_SQL,
}
