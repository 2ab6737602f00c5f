"""Log files as lines: (file, block, pos, raw).

``block`` is the byte offset of the split a line was read from and ``pos`` grows
by one from line to line within it. Blocks have a bounded size, so everything
that must follow the order of a file works per block and carries a one-row
summary from block to block; no file, however large, ends up in one task.

Where the splits lie depends on settings and cores at the moment a plan is made.
So lines are stored once before anything is counted by block, text is read a
single time, and all that follows sees the same blocks. What is known of a block is a
row of numbers under a 64-bit key of its file; lines look it up where they are.
"""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timberline.session import write_once

# How each encoding names its byte order mark and its newline.
UTF16 = {"utf-16le": ("UTF-16LE", "FFFE", "0A00"), "utf-16be": ("UTF-16BE", "FEFF", "000A")}


# Tasks for each core that list folders.
_LISTERS = 16


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Readers made in here list their files at little cost to the driver.

    Spark would run up to 10,000 tasks of a few folders each, and would keep the files of every reader in a cache that
    no other reader looks at, though the reader itself holds them already.
    """
    held = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(_LISTERS * spark.sparkContext.defaultParallelism),
        "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    }
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _scan(spark: SparkSession, paths, **options) -> DataFrame:
    reader = spark.read.options(recursiveFileLookup="true", **options)
    with listing(spark):
        lines = reader.text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def read_log_lines(spark: SparkSession, paths) -> DataFrame:
    """UTF-8 lines ended by LF, CRLF or CR; a byte order mark is dropped, bad bytes become U+FFFD."""
    return _scan(spark, paths).select("file", "block", "pos", F.make_valid_utf8("value").alias("raw"))


# A fact row takes about this much in the table that lines look it up in; up to so much of it is sent to every task.
_FACT_BYTES = 96
BROADCAST_BYTES = 64 << 20


def with_block_facts(lines: DataFrame, sums: list[Column], facts: dict[str, Column], stored: bool = False) -> DataFrame:
    """Adds ``facts`` to each line, made of the ``sums`` of its block and, by windows, of those around it.

    ``stored`` says that ``lines`` are a written table already; others are written first. A
    block has one fact row. While all of them fit in BROADCAST_BYTES (some 700,000 blocks, 80 TB in
    splits of 128 MB) lines are not shuffled; beyond that both sides are joined by file and block.
    """
    lines = lines if stored else write_once(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(*sums)
    blocks = write_once(blocks.select("file", "block", *[fact.alias(name) for name, fact in facts.items()]), "blocks")
    key = F.xxhash64("file")
    count, files, keys = blocks.agg(F.count("*"), F.count_distinct("file"), F.count_distinct(key)).first()
    if files != keys:  # two names with one hash
        return lines.join(blocks, ["file", "block"], "left")
    index = blocks.select(key.alias("_file"), F.col("block").alias("_block"), *facts)
    if count * _FACT_BYTES <= BROADCAST_BYTES:
        index = F.broadcast(index)
    same = (F.xxhash64(lines["file"]) == F.col("_file")) & (lines["block"] == F.col("_block"))
    return lines.join(index, same, "left").drop("_file", "_block")


def numbering(order: str = "pos") -> tuple[list[Column], dict[str, Column]]:
    """The sums and facts that ``numbered`` needs."""
    per_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(per_file), F.lit(0))
    return [F.min(order).alias("_first"), F.count("*").alias("_n")], {"_first": F.col("_first"), "_lines_before": before}


def numbered(lines: DataFrame, order: str = "pos") -> DataFrame:
    """``line_no`` in place of ``order`` and the facts of ``numbering``."""
    line_no = F.col(order) - F.col("_first") + F.col("_lines_before") + 1
    others = [c for c in lines.columns if c not in ("file", "block", "raw", order, "_first", "_lines_before")]
    return lines.select("file", "block", line_no.alias("line_no"), "raw", *others)


def with_line_numbers(lines: DataFrame, contiguous: bool = True, stored: bool = False) -> DataFrame:
    """Adds ``line_no``, the 1-based physical line within the file, and drops ``pos``.

    ``contiguous`` says that ``pos`` has no gaps within a block, as in a fresh
    scan; otherwise lines are ranked within their block first.
    """
    if not contiguous:
        rank = F.row_number().over(W.partitionBy("file", "block").orderBy("pos"))
        lines, stored = lines.withColumn("pos", rank.cast("bigint")), False
    return numbered(with_block_facts(lines, *numbering(), stored))


def join_runs(rows: DataFrame, order: str, text: str, start: str, separator: str) -> DataFrame:
    """Joins each row flagged ``start`` with the rows after it, up to the next start of its file.

    Rows are (file, block, order, text, start). They are shuffled once, by block;
    only a block's first and last run, which may cross its edge, move again.
    """
    in_block = W.partitionBy("file", "block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    opened = F.last(F.when(F.col(start), F.col(order)), ignorenulls=True).over(in_block)

    def joined(of):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, of))), lambda p: p[of]), separator)

    runs = (
        rows.withColumn("_run", opened)
        .groupBy("file", "block", "_run")
        .agg(F.min(order).alias(order), joined(text).alias(text))
        .withColumn("_last", F.max("_run").over(W.partitionBy("file", "block")))
    )
    at_edge = F.col("_run").isNull() | (F.col("_run") == F.col("_last"))
    along_file = W.partitionBy("file").orderBy("block", order).rowsBetween(W.unboundedPreceding, 0)
    edges = (
        runs.filter(at_edge)
        .withColumn("_run", F.last("_run", ignorenulls=True).over(along_file))
        .groupBy("file", "_run")
        .agg(joined(text).alias(text), F.min(order).alias(order))
    )
    return runs.filter(~at_edge).select("file", order, text).unionByName(edges.select("file", order, text))


def read_utf16_lines(spark: SparkSession, paths, encoding: str) -> DataFrame:
    """Lines of UTF-16 files, read in splits like any other text: (file, block, line_no, raw).

    The bytes of a newline can also straddle two characters. Such a false end
    leaves an odd number of bytes before it, so the parity of the bytes read so
    far tells true line ends, and pieces cut at false ones are joined again.
    """
    charset, mark, newline = UTF16[encoding.lower()]
    pieces = _scan(spark, paths, encoding=charset, lineSep="\n").select(
        "file", "block", "pos", F.hex(F.col("value").cast("binary")).alias("code")
    )
    odd = F.length("code") / 2 % 2
    per_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    known = with_block_facts(
        pieces,
        [F.sum(odd).alias("_odd"), F.min("pos").alias("_first")],
        {"_odd_before": F.coalesce(F.sum("_odd").over(per_file), F.lit(0)), "_first": F.col("_first")},
    )
    before = W.partitionBy("file", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    # The byte order mark is the file's first character; anywhere else it is text.
    opens = (F.col("block") == 0) & (F.col("pos") == F.col("_first"))
    flagged = known.select(
        "file",
        "block",
        "pos",
        F.when(opens, F.regexp_replace("code", f"^{mark}", "")).otherwise(F.col("code")).alias("code"),
        ((F.coalesce(F.sum(odd).over(before), F.lit(0)) + F.col("_odd_before")) % 2 == 0).alias("start"),
    )
    whole = join_runs(flagged, "pos", "code", "start", newline)
    text = F.regexp_replace(F.decode(F.unhex("code"), charset), r"\r\z", "")
    # Runs keep the order of their first piece; a block id of their own keeps groups bounded.
    block = F.shiftright("pos", 16)
    split = whole.select("file", block.alias("block"), "pos", F.posexplode(F.split(text, "\r")).alias("sub", "raw"))
    ordered = split.select("file", "block", F.struct("pos", "sub").alias("pos"), "raw")
    return with_line_numbers(ordered, contiguous=False)


def size_tier(size: Column, mb: int = 1024 * 1024) -> Column:
    """ok, warn, confirm or reject by file size; ``mb`` is the unit that the limits count in."""
    # 50, 100 and 500 MB.
    return (
        F.when(size <= 50 * mb, "ok").when(size <= 100 * mb, "warn").when(size <= 500 * mb, "confirm").otherwise("reject")
    )
