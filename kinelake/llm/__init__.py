"""Operators of a training-data pipeline: one module per operator, each with its query."""

from importlib import import_module

MODULES = ["decontaminate", "pieces", "quality", "spans", "toxicity", "extract", "chat", "sketch", "token_store", "simhash", "alignment", "phrases", "shards"]


def load_llm():
    """Import every operator module; returns (queries, oracle SQL)."""
    from kinelake.llm import common

    for name in MODULES:
        import_module(f"kinelake.llm.{name}")
    return common.QUERIES, common.ORACLES
