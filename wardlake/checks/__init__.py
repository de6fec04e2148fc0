"""Queries over the given tables that exercise every operator, and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["visits", "clinical", "coding", "readings", "evaluation", "pipelines"]


def load_queries():
    """(name -> Spark query, name -> SQL) of all check modules."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES
