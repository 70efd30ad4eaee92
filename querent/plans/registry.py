"""Registered queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Readers of files that no table gives, with their SQL: tested like the queries, but none of them.
FIXED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIXED_ORACLE: dict[str, str] = {}


class Tables:
    """The driver's tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of Tables under its name, with the SQL that DuckDB is to agree with."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[key] = sql
        return f

    return add


def fixed(sql: str) -> Callable:
    """Notes a function that reads no table, with the SQL of its rows, for the tests."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        FIXED[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        FIXED_ORACLE[f.__name__] = sql
        return f

    return add


from querent.plans import answer_queries, corruption_queries, detail_queries, file_queries, metric_queries, more_queries, report_queries, run_queries  # noqa: E402, F401
