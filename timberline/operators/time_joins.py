"""Matches along time: previous row, latest earlier row, interval containment.

Each works on time buckets. A key is spread over its buckets, so one busy key is
no single task; a one-row summary per key and bucket carries the last value on.
The width of a bucket follows from the data unless it is given: narrow enough
that all rows of a bucket together, whatever their keys, are about ``BUCKET_ROWS``.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKET_ROWS = 200_000
# A span is matched at the level whose buckets it touches at most this many of.
_TOUCHED = 16


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def time_bucket(time: Column, micros: int) -> Column:
    return F.floor(_micros(time) / micros).cast("bigint")


def bucket_micros(df: DataFrame, time: str, seconds: float | None = None) -> int:
    """The width of a bucket in microseconds; one pass over the times where ``seconds`` is not given."""
    if seconds is not None:
        return max(1, int(seconds * 1_000_000))
    low, high, rows = df.agg(F.min(_micros(F.col(time))), F.max(_micros(F.col(time))), F.count(time)).first()
    return max(1, (high - low + 1) * BUCKET_ROWS // rows) if rows else 1


def _carried(rows: DataFrame, keys: list[str], order: list[Column], value: str, bucket: str, inclusive: bool) -> DataFrame:
    """Adds the last non-NULL ``value`` up to (or before) each row of its key, as ``_last``.

    NULL is a key like any other, and a NULL time comes first.
    """
    group = [*keys, bucket]
    here = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    present = F.col(value).isNotNull()
    summary = (
        rows.groupBy(*group)
        .agg(F.max_by(value, F.when(present, F.struct(*order))).alias("_tail"))
        .withColumn("_before", F.last("_tail", ignorenulls=True).over(earlier))
        .select(*[F.col(c).alias(f"_key{n}") for n, c in enumerate(group)], "_before")
    )
    # Both sides are laid out by key and bucket, so the join adds no shuffle of the rows.
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key{n}")) for n, c in enumerate(group)])
    return (
        rows.withColumn("_here", F.last(value, ignorenulls=True).over(here))
        .join(summary, same, "left")
        .withColumn("_last", F.coalesce("_here", "_before"))
        .drop("_here", "_before", *[f"_key{n}" for n in range(len(group))])
    )


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, seconds: float | None = None
) -> DataFrame:
    """Adds ``value`` of the row before, NULL or not, within the keys; ``order`` starts with a time column.

    As ``lag``: NULL keys are one group, and NULLs come first in the order.
    """
    micros = bucket_micros(df, order[0], seconds)
    rows = df.withColumn("_bucket", time_bucket(F.col(order[0]), micros)).withColumn("_held", F.struct(F.col(value).alias("v")))
    carried = _carried(rows, keys, [F.col(c) for c in order], "_held", "_bucket", False)
    return carried.withColumn(name, F.col("_last.v")).drop("_last", "_held", "_bucket")


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: float | None = None
) -> DataFrame:
    """Each left row with the latest right row of its keys that is not later, NULLs if none.

    A NULL key or time matches nothing, on either side.
    """
    others = [c for c in right.columns if c not in keys]
    payload = F.struct(*others)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, right_time]])
    lefts = left.select(
        *keys,
        F.col(left_time).alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*[c for c in left.columns if c not in keys]).alias("_left"),
        F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"),
    )
    rights = right.filter(known).select(
        *keys,
        F.col(right_time).alias("_at"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(lefts.schema["_left"].dataType).alias("_left"),
        payload.alias("_right"),
    )
    both = lefts.unionByName(rights)
    both = both.withColumn("_bucket", time_bucket(F.col("_at"), bucket_micros(both, "_at", seconds)))
    carried = _carried(both, keys, [F.col("_at"), F.col("_side")], "_right", "_bucket", True)
    return carried.filter(F.col("_side") == 1).select(*keys, "_left.*", *[F.col(f"_last.{c}").alias(c) for c in others])


def range_join(
    points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, seconds: float | None = None
) -> DataFrame:
    """Points with the spans of the same keys that contain them (start <= time < end).

    An equi-join on key, level and bucket, which adaptive execution splits where a
    bucket is busy. Each level has buckets sixteen times as wide as the one below;
    a span stands at the lowest level where it touches few, so its length does not
    matter, and a point stands once at each level that spans are at.
    """
    micros = bucket_micros(points, time, seconds)
    real = spans.filter(F.col(start) < F.col(end))
    length = (_micros(F.col(end)) - _micros(F.col(start))) / (micros * _TOUCHED)
    level = F.greatest(F.lit(0), F.ceil(F.log(float(_TOUCHED), length))).cast("int")
    placed = real.withColumn("_level", level)
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # a dozen at most, from microseconds to ages
    if not levels:
        levels = [0]
    width = F.pow(F.lit(float(_TOUCHED)), F.col("_level")).cast("decimal(38,0)") * micros

    def bucket(at: Column) -> Column:
        return F.floor(at.cast("decimal(38,0)") / width).cast("decimal(38,0)")

    last = _micros(F.col(end)) - 1
    touched = F.sequence(bucket(_micros(F.col(start))).cast("bigint"), bucket(last).cast("bigint"))
    stand = placed.withColumn("_bucket", F.explode(touched))
    seen = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    seen = seen.withColumn("_bucket", bucket(_micros(F.col(time))).cast("bigint"))
    inside = (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))
    return seen.join(stand, [*keys, "_level", "_bucket"]).filter(inside).drop("_level", "_bucket")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], seconds: float | None = None
) -> DataFrame:
    """Pairs of rows of the same keys whose spans overlap: left start < right end and right start < left end.

    An equi-join on key, level and bucket. A span is at home at the lowest level where it touches few buckets, and
    visits the levels above, where it touches two at most. Two spans meet at the higher of their home levels, and
    of the buckets they share there the first one keeps the pair. Rows without a key, start or end
    match nothing; other columns must have different names on both sides.
    """
    starts = left.select(F.col(left_span[0]).alias("_at")).unionAll(right.select(F.col(right_span[0]).alias("_at")))
    micros = bucket_micros(starts, "_at", seconds)

    def levelled(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        low, high = _micros(F.col(span[0])), _micros(F.col(span[1])) - 1
        known = df.filter(F.col(span[0]).isNotNull() & F.col(span[1]).isNotNull()).withColumns({"_low": low, "_high": F.greatest(low, high)})
        length = (F.col("_high") - F.col("_low") + 1) / (micros * _TOUCHED)
        return known.withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log(float(_TOUCHED), length))).cast("int"))

    sides = [levelled(left, left_span), levelled(right, right_span)]
    both = sides[0].select("_own").unionAll(sides[1].select("_own")).distinct()
    levels = sorted(r[0] for r in both.collect())  # a dozen at most

    def standing(df: DataFrame, side: str) -> DataFrame:
        def at(level: int) -> Column:
            first, last = (F.floor(F.col(c) / float(micros * _TOUCHED**level)).cast("bigint") for c in ("_low", "_high"))
            place = F.struct(F.lit(level).alias("level"), (F.col("_own") == level).alias("home"), first.alias("first"), F.sequence(first, last).alias("buckets"))
            return F.when(F.col("_own") <= level, place)

        placed = df.withColumn("_place", F.explode(F.array_compact(F.array(*map(at, levels)))))
        placed = placed.withColumn("_bucket", F.explode("_place.buckets"))
        flat = placed.withColumns({"_level": F.col("_place.level"), f"_home_{side}": F.col("_place.home"), f"_first_{side}": F.col("_place.first")})
        return flat.drop("_place", "_low", "_high", "_own")

    if not levels:
        return left.join(right, keys).limit(0)
    met = standing(sides[0], "l").join(standing(sides[1], "r"), [*keys, "_level", "_bucket"])
    meant = (F.col("_home_l") | F.col("_home_r")) & (F.col("_bucket") == F.greatest("_first_l", "_first_r"))
    overlap = (F.col(left_span[0]) < F.col(right_span[1])) & (F.col(right_span[0]) < F.col(left_span[1]))
    return met.filter(meant & overlap).drop("_level", "_bucket", "_home_l", "_first_l", "_home_r", "_first_r")
