"""Named queries and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseweave.roles import Tables, oracle
from caseweave.registry.shared import SHARED_SQL

Build = Callable[[Tables], DataFrame]

QUERIES: dict[str, Build] = {}
CHECKS: dict[str, str] = {}


def case(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` may name any clinical table."""

    def keep(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = oracle(sql, SHARED_SQL)
        return build

    return keep


def runnable(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Tables(spark, folder))

    return run
