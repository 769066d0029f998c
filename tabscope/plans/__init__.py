"""Queries over the given tables: the library's operators on stand-in views, with reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries and, where SQL can say the same, the SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def all_queries() -> Catalog:
    from tabscope.plans import cleaning, faceted, modelling, profiling, sources, words

    merged = Catalog()
    for module in (sources, cleaning, faceted, profiling, words, modelling):
        merged.queries.update(module.catalog.queries)
        merged.sql.update(module.catalog.sql)
    return merged
