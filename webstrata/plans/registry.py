"""All queries of the engine with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.plans.fixtures import Views, with_views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query over the views; its SQL may name the views, and its function's name is the query's."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = with_views(" ".join(sql.split()))
        return f

    return register


def _load() -> None:
    from webstrata.plans import catalogue_queries, compare_queries, extract_queries, function_queries, rollup_queries, source_queries, stream_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
