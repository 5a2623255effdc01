"""Query registry: name -> (builder, comparison SQL)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tripwright.fixtures import VIEW_SQL

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Put the named view definitions in front of a SELECT (or of its own WITH list)."""
    body = sql.strip()
    if not views:
        return body
    ctes = ",\n".join(f"{name} AS (\n{VIEW_SQL[name]}\n)" for name in views)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def register(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, build, None if sql is None else with_views(sql, views))
        return build

    return register
