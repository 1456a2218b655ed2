"""Names of the queries, their Spark side and, where SQL can express them, their SQL side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.queries.bindings import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a function under its name, with the equivalent SQL over the named CTEs."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = with_ctes(sql, *ctes)
        return function

    return register


def query_many(variants: dict[str, tuple[Query, str | None, tuple[str, ...]]]) -> None:
    for name, (function, sql, ctes) in variants.items():
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
