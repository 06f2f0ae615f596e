"""Queries over the given tables, one or more per operator, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.sources.bindings import with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(bindings: str = "", sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL over bindings."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_bindings(bindings, sql)
        return f

    return add


from stemma.plans import catalog_queries, log_queries, reader_queries, search_queries, stream_queries, text_queries  # noqa: E402, F401
