"""The queries of this subpackage, by name, and their SQL where SQL can express them."""
from __future__ import annotations

import importlib

#: query -> (module, function)
_QUERIES = {
    "op1_toxicity": "toxicity",
    "op2_decontaminate": "decontaminate",
    "op3_language_id": "language_id",
    "op4_pii": "pii",
    "op5_simhash": "simhash",
    "op6_matroska": "matroska",
    "op7_exact_dedup": "exact_dedup",
    "op8_bpe": "bpe",
    "op9_warc": "warc",
    "op10_secrets": "secrets",
}


def queries():
    out = {}
    for name, module in _QUERIES.items():
        out[name] = importlib.import_module(f"{__package__}.{module}").query
    return out


def oracle_sql():
    out = {}
    for name, module in _QUERIES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
