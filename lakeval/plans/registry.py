"""Registered queries: name to callable and to the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("examples", "scoring", "chat", "system", "intake", "reports", "planning")


def register(sql: str | None = None):
    """Register a function ``(spark, table)`` under its name; ``table(name)`` reads a table."""

    def add(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        query.__name__, query.__doc__ = f.__name__, f.__doc__
        _QUERIES[f.__name__] = query
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
