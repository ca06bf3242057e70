"""Queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from graphloom.llm import chat, decontamination, lexical, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, substring_dedup, token_counts, warc, whitening

QUERIES = {
    "op10_separator_scan": token_counts.op10_separator_scan,
    "op11_capture_index": warc.op11_capture_index,
    "op12_tput_search": lexical.op12_tput_search,
    "op13_randomised_whitening": whitening.op13_randomised_whitening,
    "op1_hierarchical_quality": quality_classifier.op1_hierarchical_quality,
    "op2_min_max_near_dedup": near_dedup.op2_min_max_near_dedup,
    "op3_cost_balanced_packing": packing.op3_cost_balanced_packing,
    "op4_cgk_decontamination": decontamination.op4_cgk_decontamination,
    "op5_fingerprint_chat": chat.op5_fingerprint_chat,
    "op6_disclosure_pii": pii.op6_disclosure_pii,
    "op7_jump_hash_shards": sharding.op7_jump_hash_shards,
    "op8_suffix_dedup": substring_dedup.op8_suffix_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
}

ORACLES: dict[str, str] = {
    "op11_capture_index": warc.OP11_SQL,
    "op12_tput_search": lexical.OP12_SQL,
    "op2_min_max_near_dedup": near_dedup.OP2_SQL,
    "op5_fingerprint_chat": chat.OP5_SQL,
    "op7_jump_hash_shards": sharding.OP7_SQL,
    "op8_suffix_dedup": substring_dedup.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
}
