"""Approximate counts and quantiles that can be kept and merged: hours to days without the lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The relative error of a distinct count is about 1.04 / sqrt(2 ** LOG_ROWS), of a quantile's rank about 2 / K.
LOG_ROWS, K = 12, 200


def sketched(df: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """(keys, n, distinct_sketch, value_sketch): one row for each group, a few kilobytes however large it is."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(distinct, LOG_ROWS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("value_sketch"),
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups out of those of finer ones."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch")
    )


def estimated(sketches: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """(keys, n, distinct_estimate, q_<percent>): what the sketches say."""
    found = [F.kll_sketch_get_quantile_double("value_sketch", F.lit(q)).alias(f"q_{q * 100:g}") for q in quantiles]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"), *found)
