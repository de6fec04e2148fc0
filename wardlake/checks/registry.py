"""Query registry: name -> Spark query and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import Derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(derived) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Derived], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Derived(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def micros_sql(column: str) -> str:
    return f"epoch_us({column})"
