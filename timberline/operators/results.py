"""Paging, listing and export of query results."""

from math import ceil

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from timberline.schemas import display_type
from timberline.session import remove

# Rows per page, statements kept.
PAGE_ROWS = 100
RECENT = 10


def page(df: DataFrame, n: int, order: list, size: int = PAGE_ROWS) -> DataFrame:
    """Page ``n`` (from 0) of ``df`` in a fixed order."""
    return df.orderBy(*order).offset(n * size).limit(size)


# A deep page is looked for among this many ranges at a time, until a range has so few rows that it is sorted.
RANGES, SORTED_ROWS = 32, 200_000


def deep_page(df: DataFrame, n: int, order: list[str], size: int = PAGE_ROWS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """Page ``n`` of ``df`` in the ascending order of columns that tell all rows apart, without sorting what comes before.

    Keys of a sample bound ranges of the whole order; their rows are counted, and only ranges that the
    page touches are looked at further, each time about 1 / 32 of the rows. Counts are exact, so the sample decides how fast the page is
    found and never which rows it has. ``df`` is read a few times; give a stored table.
    """
    key, kinds = F.struct(*order), [df.schema[c].dataType for c in order]
    rows, skip = df, n * size
    count = df.count()
    while count > sorted_rows:
        sample = rows.select(*order).sample(min(1.0, 40 * RANGES / count), seed=1).limit(100 * RANGES)
        found = sample.orderBy(*order).collect()  # at most 3,200 keys
        bounds = list(dict.fromkeys(found[len(found) * k // RANGES] for k in range(1, RANGES))) if found else []
        limits = [F.struct(*[F.lit(v).cast(kind).alias(c) for v, kind, c in zip(b, kinds, order)]) for b in bounds]
        if not limits:
            break
        # Rows below each bound; the page lies from the last bound with no more than it skips to the first with enough.
        below = [0, *rows.agg(*[F.count_if(key < b).alias(f"b{i}") for i, b in enumerate(limits)]).first(), count]
        low = max(i for i, b in enumerate(below[:-1]) if b <= skip)
        high = next((i for i in range(low + 1, len(below)) if below[i] >= skip + size), len(below) - 1)
        if below[high] - below[low] == count:  # equal keys, which no bound tells apart
            break
        first = F.col(order[0])
        if low > 0:
            rows = rows.filter(key >= limits[low - 1])
            rows = rows.filter(first >= F.lit(bounds[low - 1][0])) if bounds[low - 1][0] is not None else rows
        if high < len(below) - 1:
            rows = rows.filter(key < limits[high - 1])
            rows = rows.filter(first.isNull() | (first <= F.lit(bounds[high - 1][0]))) if bounds[high - 1][0] is not None else rows
        skip, count = skip - below[low], below[high] - below[low]
    return rows.orderBy(*order).offset(skip).limit(size)


def page_info(df: DataFrame, n: int, size: int = PAGE_ROWS) -> dict[str, int]:
    total = df.count()
    start = min(n * size, total)
    return {"start": start, "end": min(start + size, total), "total": total, "pages": ceil(total / size)}


def decode_binary_columns(df: DataFrame) -> DataFrame:
    """Binary columns as UTF-8 text, bad bytes replaced."""

    def shown(f: T.StructField):
        column = F.col(f"`{f.name}`")
        return F.make_valid_utf8(column.cast("string")).alias(f.name) if f.dataType == T.BinaryType() else column

    return df.select(*[shown(f) for f in df.schema])


def recent_distinct(df: DataFrame, key: str, order: str, n: int = RECENT, per: str | None = None) -> DataFrame:
    """The ``n`` most recent distinct values of ``key``, newest first, in all or for each ``per``.

    Repeats are folded before the shuffle, and the rank limit is applied on both
    sides of it, so a group of any size sends no more than ``n`` rows per task.
    """
    groups = [per] if per else []
    latest = df.groupBy(*groups, key).agg(F.max(order).alias(order))
    newest = [F.col(order).desc(), F.col(key)]
    if not per:
        return latest.orderBy(*newest).limit(n)
    return latest.withColumn("rank", F.row_number().over(W.partitionBy(per).orderBy(*newest))).filter(F.col("rank") <= n)


def table_info(df: DataFrame) -> DataFrame:
    """(cid, name, type): the columns of a table as TEXT, INTEGER or REAL."""
    rows = [(i, f.name, display_type(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "cid int, name string, type string")


def export_csv(df: DataFrame, path: str) -> bool:
    """Writes a header and the rows; False, and nothing written, when there are none.

    Rows are counted as they are written, so the plan runs once.
    """
    written = Observation()
    text = decode_binary_columns(df).observe(written, F.count(F.lit(1)).alias("rows"))
    (
        text.write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if written.get["rows"]:
        return True
    remove(df.sparkSession, path)
    return False
