"""Every registered query of the engine: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: enter a query under ``name`` with the SQL that DuckDB can check it by."""

    def enter(query: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (query, sql)
        return query

    return enter


def load() -> dict[str, tuple[Query, str | None]]:
    """Import the modules that register queries and return the registry."""
    import strataloom.plans.all  # noqa: F401

    return REGISTRY
