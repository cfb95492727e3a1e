"""How a module of plans registers its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrar(queries: dict, texts: dict):
    """A decorator that registers a query under its name, with its SQL if there is one."""

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql is not None:
                texts[f.__name__] = sql
            return f

        return put

    return query
