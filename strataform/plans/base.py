"""Registration of queries with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def registry():
    """(queries, oracles, query): `query(sql)` registers the function that it decorates; sql may be None."""
    queries, oracles = {}, {}

    def query(sql: str | None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
