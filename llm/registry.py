"""The queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, language_model, ngram_join, oracles, packing, quality, secrets, sharding, substring_dedup


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
        "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_katz_scores": language_model.op4_katz_scores,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_hypergeometric_sharding": sharding.op9_hypergeometric_sharding,
        "op10_chat_formatting": chat.op10_chat_formatting,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_ngram_jaccard_join": oracles.OP1_SQL,
        "op5_secret_scan": oracles.op5_sql(secrets.RULES),
        "op8_substring_dedup": oracles.OP8_SQL,
        "op10_chat_formatting": chat.OP10_SQL,
    }
