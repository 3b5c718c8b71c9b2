"""Every named query of the library with its oracle SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, exchange, relations, retrieval, validation

_ALL = {**retrieval.QUERIES, **documents.QUERIES, **relations.QUERIES, **validation.QUERIES, **exchange.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
