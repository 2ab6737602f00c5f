"""Changes to a table as new DataFrames."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or NULL."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """All rows, with ``values`` (over the old row) where the condition holds."""
    return df.select(
        *[
            F.when(condition, values[name]).otherwise(F.col(f"`{name}`")).cast(df.schema[name].dataType).alias(name)
            if name in values
            else F.col(f"`{name}`")
            for name in df.columns
        ]
    )


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Both sets of rows; columns that ``rows`` lacks are NULL."""
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)
