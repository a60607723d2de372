"""Every registered query of the library, with its SQL for DuckDB where SQL can say the same.

Each query applies operators of siftline.functions and siftline.operators to the driver's tables;
OPERATORS names the operators' ids in the blueprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when first named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(operators: str, sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        OPERATORS[f.__name__] = operators
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from . import cohort_queries, entity_queries, filter_queries, page_queries, record_queries, report_queries, rule_queries, state_queries, triage_queries, view_queries  # noqa: E402, F401
