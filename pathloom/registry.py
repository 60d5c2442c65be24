"""All core queries by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of ``plans`` with QUERIES and SQL.
MODULES = ("ingest_queries", "record_queries", "mining_queries", "transfer_queries", "path_queries", "judge_queries", "stream_queries")


def _modules():
    return [import_module(f"{__package__}.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in _modules() for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
