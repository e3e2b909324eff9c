"""All queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_ngram_join", "q_pii", "q_quality", "q_secrets", "q_vptree", "q_decontam", "q_recurrent_lm", "q_byte_bpe", "q_line_dedup", "q_suffix_dedup")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"samelode.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"samelode.llm.{m}").ORACLE_SQL.items()}
