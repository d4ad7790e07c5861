"""The registered queries and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans import oracle
from pairloom.plans.queries import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.texts().items() if k in REGISTRY}
