"""What became of the lines of each file."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.plans.formats import get_format


def load_summary(records: DataFrame, format_name: str) -> DataFrame:
    """(file, format, row_count, skipped_count): one pass, counted before the shuffle."""
    keeps = get_format(format_name).keeps(F.col("raw"))
    keys = ["file"] if "file" in records.columns else []
    return records.groupBy(*keys).agg(
        F.lit(format_name).alias("format"),
        F.count_if(keeps).alias("row_count"),
        F.count_if(~keeps).alias("skipped_count"),
    )
