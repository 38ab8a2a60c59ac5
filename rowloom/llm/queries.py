"""The registered queries of this package, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name: module that defines it.
_MODULES = {
    "op1_embedding": "embedding",
    "op2_sentencepiece": "sentencepieces",
    "op3_simhash": "simhash",
    "op4_chat": "chat",
    "op5_mixing": "mixing",
    "op6_licenses": "licenses",
    "op7_quality_model": "quality_model",
    "op8_toxicity": "toxicity",
    "op9_quality_rules": "quality_rules",
    "op10_pii": "pii",
    "quality_ablations": "quality_rules",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"rowloom.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict:
    found = {}
    for name, module in _MODULES.items():
        sql = getattr(importlib.import_module(f"rowloom.llm.{module}"), "ORACLE_SQL", None)
        sql = sql.get(name) if isinstance(sql, dict) else sql
        if sql:
            found[name] = sql
    return found
