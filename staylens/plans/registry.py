"""The registered queries of the library, by name, with the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its name, with the SQL that says the same."""

    def put(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise KeyError(f"query {fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def load() -> None:
    """Import the modules that register queries."""
    from . import catalog_queries, derived_queries, extra_queries, merge_queries, model_queries, parse_queries, stream_queries, table_queries, text_queries  # noqa: F401
