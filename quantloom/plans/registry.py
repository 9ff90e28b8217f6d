"""Registering queries: one SQL builder serves Spark and the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..frames import DUCK, SPARK, Dialect, spark_sql
from ..sources.shared import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}


def _named(sql: str) -> str:
    """The SQL with tables by their names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def query(name: str, build: Callable[[Dialect], str]) -> None:
    """Register a query that both engines can run from the SQL that `build` gives for each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = build(SPARK)
        return spark_sql(spark, sql, **tables(spark, sf_dir, sql))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = _named(build(DUCK))


def stored_query(name: str, base: Callable[[Dialect], str], build: Callable[[Dialect, str], str]) -> None:
    """Register a query over rows that it needs more than once: Spark writes them first, the checking engine holds them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stored(relation(spark, sf_dir, base(SPARK)), name)
        return spark_sql(spark, build(SPARK, "{rows}"), rows=rows)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = _named(f"with base_rows as materialized (select * from {base(DUCK)} b) {build(DUCK, 'base_rows')}")


def spark_stored(name: str, base: Callable[[Dialect], str], build: Callable[[Dialect, str], str]) -> None:
    """Register a query over rows that Spark writes first, as it needs them more than once; the checking engine has them in place."""
    stored_query(name, base, build)
    ORACLES[name] = _named(build(DUCK, base(DUCK)))


def native(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Register a query written with the DataFrame API, with its SQL if there is one."""
    QUERIES[name] = run
    if sql:
        ORACLES[name] = _named(sql)


def bound(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL whose {names} stand for DataFrames."""
    return spark_sql(spark, sql, **frames)


def relation(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """A relation over the given tables as a DataFrame."""
    sql = f"select * from {source} rel"
    return spark_sql(spark, sql, **tables(spark, sf_dir, sql))
