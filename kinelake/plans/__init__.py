"""Registered queries, one module per operator family."""

from importlib import import_module

from kinelake.plans import registry

MODULES = ["core", "relational", "feature_queries", "reshape_queries", "evaluation_queries", "result_queries", "kernel_queries", "assembly_queries", "model_queries", "io_queries"]


def load_all():
    """Import every query module; returns (queries, oracle SQL)."""
    for m in MODULES:
        import_module(f"kinelake.plans.{m}")
    return registry.QUERIES, registry.ORACLES
