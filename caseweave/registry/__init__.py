"""All registered queries, grouped as the operator modules are."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "filters", "windows", "cohorts", "codes", "aggregates", "observation", "temporal", "graph",
    "similarity", "evaluation", "sources", "matrix",
)


def _load() -> None:
    for module in MODULES:
        import_module(f"caseweave.registry.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    from caseweave.registry.case import QUERIES, runnable

    return {name: runnable(build) for name, build in QUERIES.items()}


def all_checks() -> dict[str, str]:
    _load()
    from caseweave.registry.case import CHECKS

    return dict(CHECKS)
