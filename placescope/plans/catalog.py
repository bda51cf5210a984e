"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

MODULES = ("scoring", "naming", "signals", "spatial", "tables", "sources", "geometry", "models", "streams")


class Catalog:
    """Collects a module's queries; ``oracle`` is absent where SQL cannot say it."""

    def __init__(self) -> None:
        self.queries: dict[str, QueryFn] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
        def register(fn: QueryFn) -> QueryFn:
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return register


def _catalogs() -> list[Catalog]:
    return [importlib.import_module(f"placescope.plans.{m}").CATALOG for m in MODULES]


def all_queries() -> dict[str, QueryFn]:
    return {name: fn for c in _catalogs() for name, fn in c.queries.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for c in _catalogs() for name, sql in c.oracles.items()}
