"""Registration of driver queries: name -> builder, SQL text, survey ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_IDS: dict[str, tuple[str, ...]] = {}


def query(ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a builder under its function name; ``ids`` lists the survey rows it covers."""

    def register(build: Query) -> Query:
        name = build.__name__
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = build
        _IDS[name] = tuple(ids.split())
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def sql_texts() -> dict[str, str]:
    return dict(_SQL)


def coverage() -> dict[str, tuple[str, ...]]:
    return dict(_IDS)
