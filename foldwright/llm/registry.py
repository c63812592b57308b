"""Queries of the training-data operators, by name, and the SQL that checks them."""

from __future__ import annotations

from foldwright.llm import bpe, line_dedup, lm, mixing, near_dup, pii, quality, token_counts, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_lm": lm.op3_lm,
    "op4_mixing": mixing.op4_mixing,
    "op5_pii": pii.op5_pii,
    "op6_topk": topk.op6_topk,
    "op7_near_dup": near_dup.op7_near_dup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": bpe.op9_bpe,
    "op10_token_counts": token_counts.op10_token_counts,
}
ORACLES = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op2_quality": quality.OP2_SQL,
    "op6_topk": topk.OP6_SQL,
    "op7_near_dup": near_dup.OP7_SQL,
}
