"""Registered queries, their SQL twins and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripweave.plans import registry


def _load() -> None:
    from tripweave.plans import aggregate_queries, ingest_queries, quality_queries, series_queries, station_queries, store_queries  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return registry.runnable()


def all_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
