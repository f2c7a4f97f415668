"""All queries of the package's own operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import over

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = over(sql)
        return f

    return add


def load() -> None:
    from . import ledger_queries, more_queries, resolution_queries, scalar_queries, stock_queries, name_queries, document_queries, summary_queries, posting_queries, source_queries, learning_queries  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(SQL)
