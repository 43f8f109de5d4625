"""Queries of the text operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from weldsight.llm import ann, byte_bpe, collocations, divergence, exact_dedup, html_content, langid, mixing, near_dedup, quality_rules, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_html_content": html_content.op3_html_content,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_nearest": ann.op8_nearest,
    "op9_language": langid.op9_language,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_divergence": divergence.op11_divergence,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op6_mixing": mixing.OP6_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
