"""A catalog of named tables over a folder."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import table


class Catalog:
    """Tables by name: a folder's parquet files and data frames that are registered."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.own: dict[str, DataFrame] = {}
        self.factories: dict[str, Callable[[], DataFrame]] = {}
        self.metadata: dict[str, dict] = {}

    def names(self) -> list[str]:
        found = {f.removesuffix(".parquet") for f in os.listdir(self.folder) if f.endswith(".parquet")}
        return sorted(found | set(self.own) | set(self.factories))

    def register(self, name: str, df: DataFrame) -> None:
        """A name that's taken raises ValueError."""
        if name in self.names():
            raise ValueError(f"there is a table {name} already")
        self.own[name] = df

    def get(self, name: str) -> DataFrame:
        """An unknown name raises ValueError with the names that there are."""
        if name in self.factories and name not in self.own:
            self.own[name] = self.factories[name]()
        if name in self.own:
            return self.own[name]
        if name not in self.names():
            raise ValueError(f"no table {name}; there are {', '.join(self.names())}")
        return table(self.spark, self.folder, name)

    def fields(self, name: str) -> list[str]:
        return self.get(name).columns

    def views(self) -> None:
        """Each table as a temporary view, for SQL."""
        for name in self.names():
            self.get(name).createOrReplaceTempView(name)

    def sql(self, query: str, **args) -> DataFrame:
        """SQL with bound parameters (:name)."""
        self.views()
        return self.spark.sql(query, args=args)

    def register_factory(self, name: str, make: Callable[[], DataFrame], **metadata) -> None:
        """A table that is made when it's first asked for, with what's known of it; a name that's taken raises ValueError."""
        if name in self.names():
            raise ValueError(f"there is a table {name} already")
        self.factories[name] = make
        self.describe(name, **metadata)

    def describe(self, name: str, **metadata) -> dict:
        """What's known of a table, after adding to it; another value for what's known already raises ValueError."""
        known = self.metadata.setdefault(name, {})
        for key, value in metadata.items():
            if known.setdefault(key, value) != value:
                raise ValueError(f"{name}: {key} is {known[key]!r} already, not {value!r}")
        return dict(known)
