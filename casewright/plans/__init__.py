"""Compositions of operators: suite building, scoring, registered queries."""

from __future__ import annotations

import importlib

QUERY_MODULES = (
    "metric_queries", "index_queries", "sampling_queries", "suite_queries", "join_queries", "retrieval_queries", "run_queries",
    "source_queries",
)


def load_queries() -> None:
    """Import every module that registers queries."""
    for module in QUERY_MODULES:
        importlib.import_module(f"casewright.plans.{module}")
