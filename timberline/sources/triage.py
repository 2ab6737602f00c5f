"""Which files are text, in which encoding, and how large: one row per file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction
from pyspark.sql.window import Window as W

from timberline.functions.text import WS, has_text
from timberline.session import write_once
from timberline.sources.text_files import _scan, listing, size_tier

# A NUL byte this early marks a binary file, and so many lines are a sample.
SNIFF_BYTES = 8192
SAMPLE_LINES = 20
# A piece between line feeds with a line, ended by CR maybe, that is neither blank nor a comment.
TELLING = rf"(?s)(?:\A|\r){WS}*+(?!#)."


def list_files(spark: SparkSession, paths, mb: int = 1024 * 1024) -> DataFrame:
    """(file, bytes, tier) from the listing alone; contents are not read."""
    with listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    size = F.col("_metadata.file_size")
    return files.select(F.col("_metadata.file_path").alias("file"), size.alias("bytes"), size_tier(size, mb).alias("tier"))


def survey(spark: SparkSession, paths) -> DataFrame:
    """What one pass over the text tells of each block: a row of sums, and its first lines that may be a sample.

    (file, block, bytes, seen, first, nul, lines, mark, sample), written once; ``sample`` holds up to
    20 of (pos, value), pieces between line feeds. The pass splits at LF only, so a piece takes its
    length plus one byte, and the sum of lengths tells whether a UTF-8 mark was cut off.
    """
    lines = _scan(spark, paths, lineSep="\n")
    # As a number, so that the smallest is found by hashing; text would be sorted.
    first_bytes = F.conv(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)), 16, 10).cast("bigint")
    # Most lines show by their first byte that they are text and no comment.
    plain = F.ascii(F.substring(F.col("value"), 1, 1)).between(ord("$"), ord("~"))
    text = F.when(plain, True).otherwise(has_text(F.col("value")))
    telling = F.when(F.when(plain, True).otherwise(F.col("value").rlike(TELLING)), F.struct("pos", "value"))
    return write_once(
        lines.groupBy("file", "block").agg(
            F.max("bytes").alias("bytes"),
            F.sum(F.octet_length("value") + 1).alias("seen"),
            F.min("pos").alias("first"),
            F.min(F.when(F.contains("value", F.lit("\0")), F.col("pos"))).alias("nul"),
            F.bool_or(text).alias("lines"),
            F.min_by(first_bytes, F.col("pos")).alias("mark"),
            # The only bounded list among the aggregates; it keeps the smallest.
            InternalFunction.collect_top_k(telling, SAMPLE_LINES, True).alias("sample"),
        ),
        "survey",
    )


def triage(spark: SparkSession, paths, surveyed: DataFrame | None = None) -> DataFrame:
    """(file, bytes, tier, encoding, is_text, has_lines): the last says that a line is not blank.

    ``surveyed`` is the ``survey`` of the same paths, where there is one. Only files with a NUL in their
    first block are looked at again, and of these only the first lines.
    """
    surveyed = survey(spark, paths) if surveyed is None else surveyed
    at_start = F.col("block") == 0
    files = surveyed.groupBy("file").agg(
        F.max("bytes").alias("bytes"),
        F.sum("seen").alias("_seen"),
        F.min(F.when(at_start, F.col("first"))).alias("_first"),
        F.min(F.when(at_start, F.col("nul"))).alias("_nul"),
        F.bool_or("lines").alias("_lines"),
        F.min(F.when(at_start, F.col("mark"))).alias("_mark"),
    )
    lines = _scan(spark, paths, lineSep="\n").withColumn("size", F.octet_length("value") + 1)
    nul_at = F.when(F.contains("value", F.lit("\0")), F.octet_length(F.substring_index("value", "\0", 1)) + 1)
    encoding = (
        F.when(F.col("_mark") == 0xFFFE, "utf-16le").when(F.col("_mark") == 0xFEFF, "utf-16be").otherwise("utf-8")
    )
    mark_size = F.when(F.col("_seen") < F.col("bytes"), 3).otherwise(0)
    # Each line before a byte takes one byte or more, so a NUL after this many lines is late enough. Lines are
    # counted from the start of the file, which no change of the splits moves.
    nul_line = F.col("_nul") - F.col("_first")
    suspect = files.filter(F.col("_nul").isNotNull() & (encoding == "utf-8") & (nul_line < SNIFF_BYTES)).select(
        "file", nul_line.alias("_nul_line"), mark_size.alias("_mark_size")
    )
    listed = list_files(spark, paths)
    result = listed.join(files.drop("bytes"), "file", "left").withColumn("encoding", encoding)
    if suspect.isEmpty():
        binary = F.lit(False)
    else:
        in_file = W.partitionBy("file").orderBy("block", "pos")
        before = W.partitionBy("file").orderBy("_line").rowsBetween(W.unboundedPreceding, -1)
        early = (
            lines.join(write_once(suspect, "suspect"), "file")
            .select("file", "block", "pos", "size", nul_at.alias("_at"), "_nul_line", "_mark_size")
            .withColumn("_line", F.row_number().over(in_file) - 1)
            .filter((F.col("_line") < SNIFF_BYTES) & (F.col("_line") <= F.col("_nul_line")))
            .withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
            .filter(F.col("_line") == F.col("_nul_line"))
            .filter(F.col("_before") + F.col("_mark_size") + F.col("_at") <= SNIFF_BYTES)
        )
        result = result.join(write_once(early.select("file", F.lit(True).alias("_binary")), "binary"), "file", "left")
        binary = F.coalesce("_binary", F.lit(False))
    has_lines = ((F.col("encoding") != "utf-8") | F.coalesce("_lines", F.lit(False))).alias("has_lines")
    return result.select("file", "bytes", "tier", "encoding", (~binary).alias("is_text"), has_lines)
