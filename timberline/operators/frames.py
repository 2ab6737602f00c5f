"""Window frames that leave out the current row, its peers, or both: the EXCLUDE clause, which Spark SQL lacks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

EXCLUDE = ("CURRENT ROW", "GROUP", "TIES")
_BEST = {"min": (F.min, F.least, F.array_min), "max": (F.max, F.greatest, F.array_max)}


def with_frame(
    df: DataFrame,
    name: str,
    how: str,
    value: str,
    keys: list[str],
    order: list[str],
    start: int,
    end: int,
    exclude: str,
    ties: list[str] = (),
) -> DataFrame:
    """Adds sum, count, avg, min or max of ``value`` over ROWS from ``start`` to ``end``, without what ``exclude`` names.

    Rows of equal ``order`` are peers; ``ties`` puts them in a fixed order within the frame. Sums, counts and averages are
    those of the frame less those of the excluded part, which is a frame of the same bounds among
    the peers; sums of doubles may differ in their last digits. Minimum and maximum are those of the two frames on
    either side. There, an unbounded side must reach past the current row.
    """
    if exclude not in EXCLUDE:
        raise ValueError(f"exclude must be one of {EXCLUDE}")
    frame = W.partitionBy(*keys).orderBy(*order, *ties)
    peers = W.partitionBy(*keys, *order).orderBy(*(ties or order))
    own = F.col(value) if start <= 0 <= end else F.lit(None).cast(df.schema[value].dataType)
    if how in _BEST:
        ranked = df.withColumn("_rank", F.dense_rank().over(W.partitionBy(*keys).orderBy(*order)))
        return ranked.withColumn(name, _best(how, value, own, W.partitionBy(*keys).orderBy("_rank"), frame, start, end, exclude)).drop("_rank")
    if how not in ("sum", "count", "avg"):
        raise ValueError(f"no frame of {how}")

    def less(of, mine: Column) -> Column:
        whole = F.coalesce(of(F.col(value)).over(frame.rowsBetween(start, end)), F.lit(0))
        group = F.coalesce(of(F.col(value)).over(peers.rowsBetween(start, end)), F.lit(0))
        return whole - {"CURRENT ROW": mine, "GROUP": group, "TIES": group - mine}[exclude]

    count = less(F.count, own.isNotNull().cast("bigint"))
    if how == "count":
        return df.withColumn(name, count)
    added = F.when(count > 0, less(F.sum, F.coalesce(own, F.lit(0))))
    return df.withColumn(name, added if how == "sum" else added / count)


def _best(how: str, value: str, own: Column, ranks, frame, start: int, end: int, exclude: str) -> Column:
    of, pick, of_array = _BEST[how]
    first, last = W.unboundedPreceding, W.unboundedFollowing
    found = [own] if exclude == "TIES" else []
    for low, high in ((start, min(end, -1)), (max(start, 1), end)):
        if low > high:
            continue
        if exclude == "CURRENT ROW":
            found.append(of(value).over(frame.rowsBetween(low, high)))
        elif low > first and high < last:
            # The rows of a bounded side, without the peers among them.
            rows = F.collect_list(F.struct("_rank", F.col(value).alias("v"))).over(frame.rowsBetween(low, high))
            others = F.filter(rows, lambda r: r["_rank"] != F.col("_rank"))
            found.append(of_array(F.transform(others, lambda r: r["v"])))
        elif (low <= first and end >= 0) or (high >= last and start <= 0):
            # An unbounded side is all groups before or after.
            found.append(of(value).over(ranks.rangeBetween(first, -1) if low <= first else ranks.rangeBetween(1, last)))
        else:
            raise ValueError("an unbounded side of a frame must reach past the current row")
    return pick(*found) if len(found) > 1 else found[0] if found else F.nullif(F.col(value), F.col(value))
