"""The query catalogue: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator that registers a query under a name, with its oracle SQL."""

    def register(fn: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        _REGISTRY[name] = (fn, sql)
        return fn

    return register


def _load() -> None:
    from docfacts.plans import accounting, ingest, invoices, tables  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return {name: fn for name, (fn, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
