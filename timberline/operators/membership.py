"""NOT IN as SQL means it, by a join that shuffles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _facts(values: DataFrame) -> Column:
    """One row beside a query: whether there are no values at all, and whether a NULL is among them."""
    value = F.col(values.columns[0])
    return values.agg(F.struct((F.count("*") == 0).alias("empty"), (F.count_if(value.isNull()) > 0).alias("unknown")).alias("facts")).scalar()


def _present(values: DataFrame) -> DataFrame:
    return values.select(F.col(values.columns[0]).alias("_value")).filter(F.col("_value").isNotNull()).distinct()


def not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of ``df`` for which ``column NOT IN (values)`` is true; ``values`` has one column.

    A NULL among the values leaves no row, and a NULL column is kept only where there are no values at all. Spark
    answers NOT IN by sending all values to every task, however many. Here whether there are values, and NULLs
    among them, are two facts of one row, and the rest is a plain anti join.
    """
    facts = _facts(values)
    left = df.join(_present(values), df[column] == F.col("_value"), "left_anti")
    return left.filter(facts["empty"] | (~facts["unknown"] & F.col(column).isNotNull()))


def with_not_in(df: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, what ``column NOT IN (values)`` is for each row: true, false or NULL; ``values`` has one column.

    For a NOT IN that is part of a larger condition, which ``not_in`` can't be. Spark holds each row against each value
    there, one by one. Here it is a join with the distinct values.
    """
    facts = _facts(values)
    joined = df.join(_present(values).withColumn("_found", F.lit(True)), df[column] == F.col("_value"), "left")
    unknown = F.col(column).isNull() | facts["unknown"]
    outside = F.when(facts["empty"], True).when(F.col("_found"), False).when(~unknown, True)
    return joined.withColumn(name, outside).drop("_value", "_found")
