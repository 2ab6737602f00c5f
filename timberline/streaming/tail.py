"""The line-by-line parsers on files as they arrive."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.once import with_once
from timberline.functions.times import event_time
from timberline.operators.json_lines import JsonColumns, parse_json
from timberline.plans.formats import get_format
from timberline.session import configure


def tail_logs(
    spark: SparkSession,
    folder: str,
    format: str,
    ref_time: Column | None = None,
    columns: JsonColumns | None = None,
    watermark: str = "1 hour",
) -> DataFrame:
    """A streaming table of one format with a watermarked ``event_time``.

    Line numbers and journald records need whole files and have no streaming
    form; JSON needs its columns from an earlier batch.
    """
    known = get_format(format)
    if format == "journald":
        raise ValueError("journald records are assembled from whole files")
    configure(spark)
    lines = spark.readStream.option("recursiveFileLookup", "true").text(folder)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "value")
    lines = with_once(lines, "raw", F.make_valid_utf8("value")).drop("value")
    if format == "json":
        if columns is None:
            raise ValueError("a stream of JSON needs its columns")
        parsed = parse_json(lines, columns)
    else:
        parsed = known.parse(lines, ref_time) if known.needs_time else known.parse(lines)
    return parsed.withColumn("event_time", event_time(F.col("timestamp"))).withWatermark("event_time", watermark)
