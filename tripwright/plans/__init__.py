"""Registered queries, each with the SQL it has to agree with where such SQL exists."""
from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "q_sources", "q_projection", "q_functions", "q_joins", "q_aggregates",
    "q_windows", "q_scores", "q_models", "q_contracts", "q_variants",
)


def load_registry():
    from tripwright.plans.registry import REGISTRY

    for family in FAMILIES:
        import_module(f"tripwright.plans.{family}")
    return REGISTRY
