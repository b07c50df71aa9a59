"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query name: its module.
QUERIES = {
    "op1_chat": "chat",
    "op2_lm_score": "lm_score",
    "op3_quality": "quality",
    "op4_neighbours": "neighbours",
    "op5_token_store": "token_store",
    "op6_jaccard": "jaccard",
    "op7_langid": "langid",
    "op8_decontaminate": "decontaminate",
    "op9_mixing": "mixing",
    "op10_repeats": "repeats",
    "op11_simhash": "simhash",
    "op12_whitening": "whitening",
    "op13_divergence": "divergence",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"scanlake.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in QUERIES.items():
        sql = getattr(importlib.import_module(f"scanlake.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
