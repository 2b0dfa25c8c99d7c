"""Queries of the corpus operators, by name."""

from __future__ import annotations

from tabsieve.llm import (
    op10_decontaminate,
    op1_suffix_dedup,
    op2_language,
    op3_toxicity,
    op4_secrets,
    op5_tokens,
    op6_quality,
    op7_minhash,
    op8_mix,
    op9_html,
)

OPERATORS = (
    op1_suffix_dedup,
    op2_language,
    op3_toxicity,
    op4_secrets,
    op5_tokens,
    op6_quality,
    op7_minhash,
    op8_mix,
    op9_html,
    op10_decontaminate,
)


def queries():
    return {m.__name__.rpartition(".")[2]: m.query for m in OPERATORS}


def oracle_sql():
    """For the operators that SQL can express; the others train models or write files, and tests compare them with brute force."""
    return {m.__name__.rpartition(".")[2]: m.SQL for m in OPERATORS if hasattr(m, "SQL")}
