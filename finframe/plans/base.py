"""The query register: a name, a Spark builder and the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

BUILDERS: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder; without ``sql`` the query has no oracle."""

    def add(build: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"{name} is registered twice")
        BUILDERS[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def with_views(views: str, body: str) -> str:
    return f"WITH {views.strip()}\n{body.strip()}"
