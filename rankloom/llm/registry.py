"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from rankloom.llm import decontamination, filter_audit, huffman, line_dedup, mixing, pii, quality, sharding, simhash, spelling, suffix_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1,
        "op2_trie_token_counts": token_counts.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_source_mixing": mixing.op4,
        "op5_toxicity_knn": toxicity.op5,
        "op6_huffman_ids": huffman.op6,
        "op7_pii_weak_supervision": pii.op7,
        "op8_quality_forest": quality.op8,
        "op9_virtual_slot_sharding": sharding.op9,
        "op10_template_decontamination": decontamination.op10,
        "op11_spelling_variants": spelling.op11,
        "op12_filter_audit": filter_audit.op12,
        "op13_suffix_dedup": suffix_dedup.op13,
    }


def oracle_sql() -> dict:
    return {
        "op3_line_dedup": line_dedup.SQL,
        "op4_source_mixing": mixing.SQL,
        "op12_filter_audit": filter_audit.SQL,
        "op13_suffix_dedup": suffix_dedup.SQL,
    }
