"""Registry of named queries: a Spark builder and, where one exists, DuckDB SQL.

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver's parquet tables. The SQL text runs in DuckDB against views with the same
table names and must return the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

SPARK: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name`` with its oracle SQL (None = rows-only)."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in SPARK:
            raise ValueError(f"duplicate query {name}")
        SPARK[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from auditspark.plans import queries  # noqa: F401
