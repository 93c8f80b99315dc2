"""All registered queries of the engine's own operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("sources", "cleaning", "terminology", "chunking", "vectors", "topics", "lessons", "memory", "bank", "retrieval", "checks", "flows")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a (spark, sf_dir) function under an operator's name, with its DuckDB equivalent."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name.replace(".", "_")] = f
        if sql:
            ORACLES[name.replace(".", "_")] = sql
        return f

    return add


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"chalkline.plans.{module}_queries")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return QUERIES["agg_roles"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return QUERIES


def oracles() -> dict[str, str]:
    load()
    return ORACLES
