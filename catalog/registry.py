"""Queries over the driver tables, each next to the SQL that gives the same answer.

Log text is made from the tables in Spark and then read, detected and parsed by
the library; the SQL computes the result from the table columns directly.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, folder) under its name, with its SQL."""

    def add(function):
        key = name or function.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def log_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that lines are made of.

    A file of one row group is read by one task, so its rows are dealt out before parsing.
    """
    return table(spark, folder, name).repartition(spark.sparkContext.defaultParallelism)
