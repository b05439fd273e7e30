"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module; each module has a function of the query's name.
MODULES = {
    "op1_token_counts": "token_counts",
    "op2_surrogates": "surrogates",
    "op3_topk_maxscore": "maxscore",
    "op4_quality_classifier": "quality",
    "op5_line_dedup": "winnowing",
    "op6_packing": "packing",
    "op7_lm_scoring": "bilinear",
    "op8_quality_rules": "quality",
    "op9_jaccard_join": "chosen_path",
    "op10_mixing": "mixing",
}


_LOADED = {name: import_module(f"reckon.llm.{module}") for name, module in MODULES.items()}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _LOADED.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(module, "ORACLE_SQL", None) for name, module in _LOADED.items()}
    return {name: sql for name, sql in found.items() if sql}
