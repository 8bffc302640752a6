"""Named queries over the test tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindings.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(names: tuple[str, ...], body: str) -> str:
    """The SQL text preceded by the views it reads, in order."""
    if not names:
        return body
    parts = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in names)
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        return f"WITH {parts},\n{head[5:]}"
    return f"WITH {parts}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of the tables under a name, with its SQL if it has one."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return build

    return register
