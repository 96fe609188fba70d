"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_language", "op2_lines", "op3_mix", "op4_revisits", "op5_simhash", "op6_tokens", "op7_licenses", "op8_decontaminate", "op9_hmm", "op10_quality", "op11_whitening", "op12_packing", "op13_trie")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLE_SQL.items()}
