"""Registered queries: every operator applied to the provided tables, with a SQL twin where SQL can say it."""
from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FAMILIES = (
    "charts", "filters", "reshape", "joins", "aggregates", "ordering", "sets", "scalars", "quality",
    "cleaning", "learning", "search", "corpus", "monitoring", "state", "streams", "storage", "plugins",
)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Family:
    """Collects the queries of one module."""

    def __init__(self) -> None:
        self.items: dict[str, Query] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(fn):
            if name in self.items:
                raise ValueError(f"query {name} is registered twice")
            self.items[name] = Query(fn, sql.strip() if sql else None)
            return fn

        return keep


class Tables:
    """Parquet tables of one folder by attribute; columns are pruned and filters pushed by Catalyst."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._path}/{name}.parquet")


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        module = importlib.import_module(f"millrace.catalog.{family}")
        for name, query in module.family.items.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return dict(sorted(found.items()))
