"""Every query of the core, by name, and its oracle SQL.

A plan module registers a query with `@query(sql)`: the function takes (spark, sf_dir) and returns a DataFrame over whole tables; the
SQL is an independent statement of the same result, in DuckDB's dialect, with the same column names.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("corpus", "texts", "campaigns", "models", "evaluation", "answers", "relational", "experiments")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql:
            _sql[function.__name__] = sql
        return function

    return add


def _load() -> None:
    for name in MODULES:
        import_module(f"postmill.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
