"""Named queries: a Spark callable and, where SQL can say it, the matching check text."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .views import Tables, oracle

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under a name, with its check text."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def _load() -> None:
    for module in sorted(Path(__file__).parent.glob("*_queries.py")):
        import_module(f".{module.stem}", __package__)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    _load()
    return QUERIES[name](Tables(spark, folder))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, folder, fn=fn: fn(Tables(spark, folder))) for n, fn in QUERIES.items()}


def check_texts() -> dict[str, str]:
    _load()
    return {n: oracle(sql) for n, sql in CHECKS.items()}
