"""Registered queries: each a Spark function and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module with their SQL, kept side by side."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn

        return add


def registries() -> list[Registry]:
    from telemap.plans import bag_queries, curation_queries, label_queries, vector_queries

    return [m.REGISTRY for m in (curation_queries, bag_queries, label_queries, vector_queries)]


def all_queries() -> dict[str, Query]:
    return {name: fn for reg in registries() for name, fn in reg.queries.items()}


def all_sql() -> dict[str, str]:
    return {name: text for reg in registries() for name, text in reg.sql.items()}
