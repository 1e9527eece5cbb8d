"""Queries by name, each next to the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripweave.plans.workspace import Workspace, workspace

Build = Callable[[Workspace], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` is its twin over the prelude's tables, None if there is no SQL form."""

    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries as ``(spark, sf_dir) -> DataFrame``."""

    def bind(build: Build) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(workspace(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
