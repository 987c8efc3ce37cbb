"""Queries over the driver's tables, and the SQL that says the same to DuckDB."""
import importlib

#: Modules of queries; each registers its own.
MODULES = ("q_text", "q_lexicon", "q_eval", "q_io")


def load():
    """All registered queries and their SQL."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
