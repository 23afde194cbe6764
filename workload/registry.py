"""Registration of queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the survey ids it covers."""

    def register(fn: Query) -> Query:
        name = fn.__name__
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
