"""Named queries over the shared tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function and, if given, the SQL that must agree with it."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load() -> None:
    """Import the modules that register queries."""
    from tallyseek.plans import (  # noqa: F401
        queries_forecast,
        queries_retail,
        queries_retrieval,
        queries_tables,
        queries_text,
    )
