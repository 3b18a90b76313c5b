"""A register of queries, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Register:
    """Collects the queries of a module: `@queries("name", sql)` above a function of (spark, folder)."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f: Callable[[SparkSession, str], DataFrame]):
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
