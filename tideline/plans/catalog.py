"""Registry of runnable queries and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the statement it must agree with."""

    def register(fn: Query) -> Query:
        label = name or fn.__name__
        QUERIES[label] = fn
        if sql:
            ORACLE[label] = sql
        return fn

    return register
