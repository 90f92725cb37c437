"""The queries this subpackage registers, and SQL for those SQL can express."""

from __future__ import annotations

from genoloom.llm import cotraining, exact_dedup, mixing, packing, pii, simhash, simple8b, suffix_tree, topk, toxicity


def queries() -> dict:
    return {
        "op1_suffix_tree_scores": suffix_tree.op1_suffix_tree_scores,
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_simple8b": simple8b.op3_simple8b,
        "op4_cotrained_quality": cotraining.op4_cotrained_quality,
        "op5_simhash_gray": simhash.op5_simhash_gray,
        "op6_deobfuscated_pii": pii.op6_deobfuscated_pii,
        "op7_retrieval_packing": packing.op7_retrieval_packing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_term_at_a_time": topk.op9_term_at_a_time,
        "op10_noisy_channel_toxicity": toxicity.op10_noisy_channel_toxicity,
    }


def oracle_sql() -> dict:
    return {"op2_source_mixing": mixing.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op9_term_at_a_time": topk.ORACLE}
