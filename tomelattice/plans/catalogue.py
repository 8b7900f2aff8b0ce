"""The queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomelattice.plans import documents, search, trees

_ALL: dict[Callable, str | None] = documents.QUERIES | search.QUERIES | trees.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _ALL.items() if sql}
