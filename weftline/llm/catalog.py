"""The queries of this subpackage: name -> function of (spark, sf_dir), and DuckDB SQL where it can express one."""

from __future__ import annotations

from . import embedding_dedup, fill_in_middle, language_id, minhash_dedup, packing, pii, quality_classifier, quality_rules, sentencepiece_ops, sessions, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_packing": packing.op4,
    "op5_quality_classifier": quality_classifier.op5,
    "op6_pii": pii.op6,
    "op7_embedding_dedup": embedding_dedup.op7,
    "op8_minhash_dedup": minhash_dedup.op8,
    "op9_suffix_dedup": suffix_dedup.op9,
    "op10_sentencepiece": sentencepiece_ops.op10,
    "op11_toxicity": toxicity.op11,
    "op12_gap_sessions": sessions.op12,
    "op13_fill_in_middle": fill_in_middle.op13,
}
ORACLES = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op7_embedding_dedup": embedding_dedup.OP7_SQL,
    "op8_minhash_dedup": minhash_dedup.OP8_SQL,
    "op12_gap_sessions": sessions.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
