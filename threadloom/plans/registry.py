"""Named queries over the driver's tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from threadloom.sources.relations import oracle, relation

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("telemetry_queries", "text_queries", "fact_queries", "reduction_queries", "state_queries", "message_queries", "stream_queries", "more_queries", "context_queries", "rule_queries")


def query(name: str, *relations: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the named relations as a query; ``sql`` is its oracle."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: build(*(relation(spark, sf_dir, r) for r in relations))
        if sql is not None:
            _ORACLES[name] = oracle(sql)
        return build

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"threadloom.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canary assessment."""
    return queries()["canary_assessment"](spark, sf_dir)
