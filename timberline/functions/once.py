"""Ways to compute a value once that is used many times.

The optimizer merges projections and moves filters below them, and repeats an
expression wherever its column is used; a parse would run several times and the
plan would grow with every step.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column made by a generator of one row, which filters are not moved past."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_captured(df: DataFrame, name: str, pieces: Column, count: int) -> DataFrame:
    """The same, for the rows where a capture has all its pieces; one run of the pattern tests and splits a line."""
    return df.select("*", F.explode(F.filter(F.array(pieces), lambda v: F.size(v) == count)).alias(name))


def with_present(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The same, for the rows whose value is not NULL."""
    return df.select("*", F.explode(F.filter(F.array(value), lambda v: v.isNotNull())).alias(name))
