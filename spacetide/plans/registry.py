"""Query registry: name -> (callable, optional DuckDB text)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY: dict[str, str] = {}

MODULES = [
    "verb_queries",
    "source_queries",
    "window_queries",
    "join_queries",
    "event_queries",
    "aggregate_queries",
    "trajectory_queries",
    "geometry_queries",
    "model_queries",
    "governance_queries",
    "stream_queries",
]


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists SURVEY section 2 ids, ``sql`` is its DuckDB twin."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        SURVEY[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    """Import every query module once."""
    for module in MODULES:
        import_module(f"{__package__}.{module}")
