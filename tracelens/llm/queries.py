"""The registered training-data queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from tracelens.llm import centroids, chat, decontam, extraction, lines, negatives, packing, probminhash, quality, sharding, spans, suffix, tokencount


def queries():
    return {
        "op1_benchmark_decontamination": decontam.op1,
        "op2_line_dedup": lines.op2,
        "op3_minhash_near_dedup": probminhash.op3,
        "op4_suffix_array_dedup": suffix.op4,
        "op5_quality_rules": quality.op5,
        "op6_chat_formatting": chat.op6,
        "op7_best_fit_packing": packing.op7,
        "op8_token_counts": tokencount.op8,
        "op9_sharding": sharding.op9,
        "op10_substring_dedup": spans.op10,
        "op11_hard_negatives": negatives.op11,
        "op12_centroid_clustering": centroids.op12,
        "op13_html_extraction": extraction.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": decontam.OP1_SQL,
        "op4_suffix_array_dedup": suffix.OP4_SQL,
        "op6_chat_formatting": chat.OP6_SQL,
        "op9_sharding": sharding.OP9_SQL,
        "op11_hard_negatives": negatives.OP11_SQL,
        "op12_centroid_clustering": centroids.OP12_SQL,
        "op13_html_extraction": extraction.OP13_SQL,
    }
