"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of the last seven bytes cuts a text where it falls under a limit,
so cuts depend on nearby text only. Each piece gives one of 64 letters, and the
letters are the signature at that block size (about the bytes per piece). A
fingerprint holds the signatures of one block size and of twice that:
``size:letters:letters``. Two fingerprints are compared by edit distance
(insertions and deletions) where they have a block size in common.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timberline.llm.common import mix

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST, LARGEST, WANTED, MOST = 1, 1 << 31, 64, 128
WINDOW = 7
LEAST_RANGES = 256  # tasks of a corpus of more than a few MB
_BYTES = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_M = 0x2C1B3C6D
_POWERS = [np.uint32(pow(_M, k, 1 << 32)) for k in (1, 2, 4, 6)]
_RUN = re.compile(r"(.)\1{3,}")


def rolling(data: bytes) -> np.ndarray:
    """A 32-bit hash of the last seven bytes at each position; never zero."""
    one = _BYTES[np.frombuffer(data, np.uint8)]
    m1, m2, m4, m6 = _POWERS

    def plus(a: np.ndarray, b: np.ndarray, far: int, factor: np.uint32) -> np.ndarray:
        out = a.copy()
        out[far:] += b[: max(0, len(b) - far)] * factor
        return out

    two = plus(one, one, 1, m1)
    four = plus(two, two, 2, m2)
    six = plus(four, two, 4, m4)
    h = plus(six, one, 6, m6)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (h ^ (h >> np.uint32(15))) | np.uint32(1)


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes; equal bytes give equal fingerprints.

    The block size is the power of two that makes about 32 to 64 pieces, doubled
    while there are more than 128 (a text that repeats itself can cut everywhere).
    """
    if not data:
        return f"{LEAST}::"
    h = rolling(data)
    size = LEAST
    while size * WANTED < len(data):
        size *= 2
    cuts = np.flatnonzero(h < (1 << 32) // size)
    while len(cuts) < WANTED // 2 and size > LEAST:
        size //= 2
        cuts = np.flatnonzero(h < (1 << 32) // size)
    while len(cuts) > MOST and size < LARGEST:
        size *= 2
        cuts = cuts[h[cuts] < (1 << 32) // size]
    twice = cuts[h[cuts] < (1 << 32) // (2 * size)]
    return f"{size}:{_letters(data, cuts)}:{_letters(data, twice)}"


def _letters(data: bytes, cuts: np.ndarray) -> str:
    view, out, start = memoryview(data), [], 0
    for cut in (cuts + 1).tolist():
        out.append(LETTERS[crc32(view[start:cut]) & 63])
        start = cut
    if start < len(data):
        out.append(LETTERS[crc32(view[start:]) & 63])
    return "".join(out)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    # By chance, letters fall in the same order here and there, but not in a row; runs of one letter don't count as rows.
    x, y = _RUN.sub(r"\1\1\1", a), _RUN.sub(r"\1\1\1", b)
    row = min(WINDOW, max(2, min(len(x), len(y)) // 3))
    if {x[i : i + row] for i in range(len(x) - row + 1)}.isdisjoint(y[i : i + row] for i in range(len(y) - row + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 less the edit distance over the letters, at the best block size in common; 0 if there is none."""
    if a == b:
        return 1.0
    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    sa, sb = int(sa), int(sb)
    if sa == sb:
        return max(_alike(a1, b1), _alike(a2, b2))
    if sa == 2 * sb:
        return _alike(a1, b2)
    return _alike(a2, b1) if sb == 2 * sa else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row; a null text counts as empty."""
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), n, pa.array([fingerprint(t.encode()) for t in texts])], ["_id", "n_chars", "fingerprint"]
            )

    return source.mapInArrow(run, f"_id {dict(source.dtypes)['_id']}, n_chars long, fingerprint string").withColumnRenamed("_id", id_col)


def in_ranges(docs: DataFrame, per_task: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, extra, id, text): rows dealt by ranges of the id, each range followed by the first row of the next.

    Rows come in descending id within a task, nulls last and equal ids by text; the
    row after the last is the first again. The text moves once, and the first row of
    a range is sent to the range before as well (``extra`` is 1). Tasks read rows as a
    stream, so a range may be larger than memory; there are at most 10,000 ranges.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(min(10_000, max(1, -(-size // per_task))))
    if parts > 1:
        parts = max(parts, LEAST_RANGES)
    points = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("id", points, 20 * parts)).first()[0] if points else None
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        at = 1 + np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(np.where(known, at, 0).astype(np.int32))

    placed = rows.withColumn("part", part_of("id"))
    firsts = rows.withColumn("part", part_of("id")).groupBy("part").agg(F.max("id").alias("first"))
    before = F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy()))
    firsts = firsts.select("part", "first", before.alias("before"))  # at most 10,001 rows
    home = F.struct("part", F.lit(0).alias("extra"))
    away = F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))
    homes = F.when(F.col("id").eqNullSafe(F.col("first")), F.array(home, away)).otherwise(F.array(home))
    sent = placed.join(F.broadcast(firsts), "part").select(F.explode(homes).alias("to"), "id", "text").select("to.*", "id", "text")
    return sent.repartition(parts, "part").sortWithinPartitions("part", "extra", F.col("id").desc_nulls_last(), "text")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against an edited form of itself, and against the next in descending id.

    The edited text has its last third replaced by the start of the next document
    (after the last comes the first). Columns: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as
    empty; equal ids follow each other by text; a single row is its own next. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds)))

    def result(id_, text, print_, next_text, next_print):
        cut = len(text) // 3
        edited = (text[: len(text) - cut] + next_text[:cut]).encode()
        new = fingerprint(edited)
        return id_, len(text), hashlib.sha256(edited).hexdigest(), print_, new, likeness(print_, new), likeness(print_, next_print)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, out = None, []
        for batch in batches:
            for part, extra, id_, text in zip(*(batch.column(c) for c in ("part", "extra", "id", "text"))):
                part, extra, text = part.as_py(), extra.as_py(), text.as_py()
                if extra and waiting is None:
                    continue  # one of several rows with the first id
                print_ = fingerprint(text.encode())
                if waiting is not None:
                    out.append(result(*waiting, text, print_))
                waiting = None if extra else (id_.as_py(), text, print_)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                    out = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    kind = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(docs, id_col=id_col, text_col=text_col).mapInArrow(run, kind).withColumnRenamed("_id", id_col)
