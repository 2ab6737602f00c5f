"""Mixing sources to target weights by the cube method (balanced sampling).

A source whose target is r times its size takes each document floor(r) times, and
once more with probability r - floor(r). Those extra takings are drawn by the cube
method: the vector of probabilities moves along the null space of the balancing
constraints (documents and tokens) until all but a few are 0 or 1, so the sums
stay at their expected values. Blocks of documents move on their own, what stays
undecided in them is gathered and moves again, and the last few of a source land.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timberline.llm.common import Scratch

WEIGHTS = (5.0, 2.0, 1.0)  # Fixed values.
BUDGET = 1.5  # Fixed value.
MOST = 2.0  # Fixed value.
BLOCK = 4096
_EDGE = 1e-9
_UNDECIDED = f"chance > {_EDGE} AND chance < 1 - {_EDGE} AND size > 0"


def _settled(p: float) -> float:
    return 0.0 if p < _EDGE else 1.0 if p > 1 - _EDGE else p


def flight(chances: list[float], sizes: list[int], draws: Iterator[float]) -> list[float]:
    """Moves probabilities until at most two lie strictly between 0 and 1.

    Three undecided documents at a time move along the vector that changes neither
    their number nor their tokens; the step has expectation zero and decides one.
    """
    p = list(chances)
    open_: list[int] = []
    for i in range(len(p)):
        p[i] = _settled(p[i])
        if p[i] in (0.0, 1.0):
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = down = math.inf
            for k, x in zip(open_, u):
                if x:
                    up = min(up, (1 - p[k]) / x if x > 0 else -p[k] / x)
                    down = min(down, p[k] / x if x > 0 else (p[k] - 1) / x)
            step = up if next(draws) * (up + down) < down else -down
            for k, x in zip(open_, u):
                p[k] = _settled(p[k] + step * x)
            open_ = [k for k in open_ if 0 < p[k] < 1]
    return p


def land(chances: list[float], sizes: list[int], draws: Iterator[float]) -> list[float]:
    """Decides the last undecided ones: tokens are balanced by the larger, then each is drawn."""
    p = [_settled(x) for x in chances]
    open_ = sorted((k for k in range(len(p)) if 0 < p[k] < 1), key=lambda k: (-sizes[k], k))
    while len(open_) >= 2:
        a, b = open_[:2]
        # Keeps sizes[a] * p[a] + sizes[b] * p[b] as it is.
        x, y = float(sizes[b]), -float(sizes[a])
        up, down = min((1 - p[a]) / x, -p[b] / y), min(p[a] / x, (p[b] - 1) / y)
        step = up if next(draws) * (up + down) < down else -down
        p[a], p[b] = _settled(p[a] + step * x), _settled(p[b] + step * y)
        open_ = [k for k in open_ if 0 < p[k] < 1]
    for k in open_:
        p[k] = float(next(draws) < p[k])
    return p


def uniform(seed: str) -> Iterator[float]:
    """The same numbers in [0, 1) for the same seed, on any machine."""
    k = 0
    while True:
        for (x,) in struct.iter_unpack("<Q", hashlib.blake2b(f"{seed}:{k}".encode()).digest()):
            yield (x >> 11) * 2.0**-53
        k += 1


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size), one row per source.

    Sources in code point order, null last, take the weights in turn and share
    ``budget`` of all sizes by them; a share stops at ``most`` times its source's
    size, and the excess is shared out again until none is above. Solved at once:
    sources fill up in the order of limit / weight, and the others share the rest.
    """
    if budget > most:
        raise ValueError("the budget can't exceed the largest target")
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before, onwards = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    share = F.col("left") / F.sum("weight").over(onwards)  # per weight, if all before this one are full
    per = per.withColumn("share", share).withColumn("full", F.col("limit") <= F.col("share") * F.col("weight"))
    # The first that isn't full sets the share of itself and all after it.
    per = per.withColumn("place", F.row_number().over(order))
    level = F.min(F.when(~F.col("full"), F.struct("place", "share"))).over(everything)["share"]
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return per.select("source", "source_size", target.alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    scratch: Scratch,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, size, source_size, target, times, taken) of every row.

    Size is the number of words (null text: 0); taken = times * size, and times is at
    most ``most`` rounded up. A document without words is taken as often as its
    source's rounded-down ratio. A null source is a source of its own. Rows with null
    or repeated ids are documents like any other; equal rows share their fate. An
    empty table gives an empty result. The same rows give the same result. Other
    columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = rows.select("_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("_id", "source", "text").alias("mark"))
    rows = scratch.keep(rows, "sizes")
    goals = scratch.keep(targets(rows, weights, budget, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("chance", ratio - F.floor(ratio))
    columns = ["_id", "source", "size", "source_size", "target", "whole", "mark", "chance"]
    open_, decided, level = rows.select(columns), [], 0
    while True:
        counts = open_.filter(_UNDECIDED).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select(F.col("source").alias("_source"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        most_blocks = (counts := scratch.keep(counts, f"blocks-{level}")).agg(F.max("blocks")).first()[0]
        decided.append(open_.filter(f"NOT ({_UNDECIDED})"))
        if most_blocks is None:
            break
        dealt = open_.filter(_UNDECIDED).join(counts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(level)), F.col("blocks")))
        moved = dealt.groupBy("source", "block").applyInPandas(_mover(f"{seed}:{level}"), dealt.select(columns).schema)
        open_ = scratch.keep(moved, f"moved-{level}")
        level += 1
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    times = F.col("whole") + F.round("chance").cast("long")
    out = out.withColumn("times", times).withColumn("taken", times * F.col("size"))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "times", "taken")


def _mover(seed: str):
    def move(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["mark", "size"], ignore_index=True)
        draws = uniform(f"{seed}:{block['source'][0]}:{block['block'][0]}")
        sizes = block["size"].tolist()
        moved = flight(block["chance"].tolist(), sizes, draws)
        if block["blocks"][0] == 1:
            moved = land(moved, sizes, draws)
        return block.assign(chance=moved).drop(columns=["blocks", "block"])

    return move
