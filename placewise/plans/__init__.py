"""Registered queries."""
from __future__ import annotations

import importlib

MODULES = ("scoring_queries", "relational_queries", "function_queries", "spatial_queries", "catalog_queries", "model_queries", "detail_queries")


def load():
    from . import registry
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLE
