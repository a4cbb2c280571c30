"""Where query modules register what they run, with SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens_sql(c: str) -> str:
    """White-space tokens in SQL."""
    return f"coalesce(len(regexp_extract_all({c}, '\\S+')), 0)::BIGINT"


def numbers(spark: SparkSession, values: tuple[int, ...], name: str = "budget") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} int")
