"""Every query of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quillon.session import bound_batches

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["text_queries", "runlog_queries", "vector_queries", "lexical_queries", "join_queries", "graph_queries", "retrieval_queries", "store_queries", "model_queries", "source_queries", "index_queries", "engine_queries"]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        bound_batches(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its name, with the SQL that it must match (if SQL can say it)."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        _queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in MODULES:
        import_module(f"quillon.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
