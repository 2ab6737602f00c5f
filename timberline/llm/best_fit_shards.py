"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) are sorted by size, and each enters the shard with
the tightest remaining capacity that still holds it, found in a balanced order
of the gaps. For a number of shards, the driver packs at most ``3 * items`` entries
whatever the corpus: groups of at least ``total / items`` bytes one by one, and
the smaller ones as bundles of about half that size, made by hash. For a given
capacity, regions of about 64 shards are packed the same way, each in a task of
its own. Bundles stay whole, so groups do.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timberline.llm.common import Scratch, numbered

ITEMS = 8192
PER_REGION = 64


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size, and the number of bins of ``capacity``; a size over it has a bin of its own."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    gaps: list[tuple[int, int]] = []  # (remaining, bin), kept in order
    place, bins = [0] * len(sizes), 0
    for i in order:
        k = bisect_left(gaps, (sizes[i], -1))
        if k < len(gaps):
            left, bin_ = gaps.pop(k)
        else:
            left, bin_, bins = max(capacity, sizes[i]), bins, bins + 1
        place[i] = bin_
        insort(gaps, (left - sizes[i], bin_))
    return place, bins


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity found at which best-fit-decreasing needs at most ``shards`` bins (by halving)."""
    low, high = max([-(-sum(sizes) // shards), *sizes, 1]), max(2 * sum(sizes), 1)
    while low < high:
        middle = (low + high) // 2
        if best_fit_decreasing(sizes, middle)[1] <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _packed_regions(entries: DataFrame, scratch: Scratch, regions: int, capacity: int) -> DataFrame:
    """Each region packed alone; shards are numbered region after region."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("entry", ignore_index=True)
        place, _ = best_fit_decreasing(group["bytes"].tolist(), capacity)
        return group.assign(bin=place)[["entry", "region", "bin"]]

    dealt = entries.withColumn("region", F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(regions)))
    packed = scratch.keep(dealt.groupBy("region").applyInPandas(pack, "entry string, region long, bin long"), "packed")
    before = W.orderBy("region").rowsBetween(W.unboundedPreceding, -1)
    shifts = packed.groupBy("region").agg((F.max("bin") + 1).alias("n"))
    shifts = shifts.select("region", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return packed.join(shifts, "region").select("entry", (F.col("bin") + F.col("shift")).cast("int").alias("shard"))


def shard(
    docs: DataFrame,
    scratch: Scratch,
    shards: int | None = None,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    items: int = ITEMS,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    Give ``shards`` to get that many of nearly equal bytes, or ``capacity`` to get
    as few shards of that many bytes as best fit finds. Rows of equal text share
    a shard. A null text counts as empty; null and repeated ids are rows like any
    other; an empty table gives an empty result. A group larger than the capacity
    has a shard of its own. Other columns are ignored, whatever their names.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    if (shards or capacity) < 1:
        raise ValueError("shards and capacity must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        ),
        "rows",
    )
    groups = scratch.keep(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    regions = 1 if capacity is None else max(1, -(-total // (PER_REGION * capacity)))
    unit = max(1, -(-total // items) if capacity is None else PER_REGION * capacity // items)
    bundles = max(1, -(-2 * total // unit))
    small = F.pmod(F.xxhash64("key"), F.lit(bundles)).cast("string")
    groups = groups.withColumn("entry", F.when(F.col("bytes") < unit, small).otherwise(F.hex("key")))
    entries = groups.groupBy("entry").agg(F.sum("bytes").alias("bytes"))
    if capacity is None:
        found = sorted((r.entry, r.bytes) for r in entries.collect())  # at most 3 * items entries
        sizes = [b for _, b in found]
        place, _ = best_fit_decreasing(sizes, smallest_capacity(sizes, shards))
        placed = spark.createDataFrame([(e, p) for (e, _), p in zip(found, place)], "entry string, shard int")
    else:
        placed = _packed_regions(entries, scratch, regions, capacity)
    homes = groups.join(placed, "entry").select("key", "shard")
    out = rows.join(homes, "key").select("id", "size", "text_crc32", "shard")
    order = [F.col("id"), F.col("text_crc32"), F.col("size")]
    return numbered(out, ["shard"], order, count, "slot").withColumnRenamed("id", id_col)
