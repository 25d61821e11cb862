"""Registered queries: each runs one operator over whole tables.

A query is a function of `Tables`; where the operator can be stated in SQL the
registration carries the equivalent statement for an independent check.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "corpus", "text_functions", "titles", "retrieval", "similarity", "dedupe", "matching", "lifecycle", "evaluation", "pages", "chapters", "state",
]

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


class Tables:
    """Lazy readers of the input tables, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its SQL statement if there is one."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")


def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return QUERIES[name](Tables(spark, folder))

    run.__name__ = name
    run.__doc__ = QUERIES[name].__doc__
    return run
