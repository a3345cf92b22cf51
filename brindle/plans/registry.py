"""Registration of queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name; ``sql`` is its DuckDB form, if it has one."""

    def wrap(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return wrap


#: Typed cases: small fixed inputs with their SQL, for the tests alone.
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def case(sql: str):
    """Keeps a function on typed input as a case of the tests; it is no query, since it reads no table."""

    def wrap(function):
        CASES[function.__name__] = (function, sql)
        return function

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df  # tables of long texts


def sql_list(items) -> str:
    """A DuckDB list literal of strings."""
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"
