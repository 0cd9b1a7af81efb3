"""All queries over the reference tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "r67_quote_answers"
MODULES = ["texts", "security", "retrieval", "answers", "records", "streams"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame and the DuckDB SQL of the same rows."""

    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def load() -> None:
    for m in MODULES:
        import_module(f"attesta.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)
