"""Registration of queries, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registrar() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, SQL, decorator): ``@query(sql)`` registers a function under its name; None for queries beyond SQL."""
    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
