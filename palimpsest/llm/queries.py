"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, ctph, ctxmix, mixing, pages, pii, quality, setsketch, sharding, substrings

QUERIES = {
    "op1_lm_scoring": ctxmix.op1_lm_scoring,
    "op2_sharding": sharding.op2_sharding,
    "op3_pii": pii.op3_pii,
    "op4_ctph": ctph.op4_ctph,
    "op5_pages": pages.op5_pages,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_near_dedup": setsketch.op7_near_dedup,
    "op8_bpe": bpe.op8_bpe,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_mixing": mixing.op10_mixing,
}
ORACLE_SQL = {
    "op7_near_dedup": setsketch.ORACLE,
    "op9_substring_dedup": substrings.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
