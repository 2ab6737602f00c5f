"""What the operators share: words, hashes, scratch tables, numbering, components."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timberline.session import scratch_path

_MASK = (1 << 64) - 1


# Rows that go to a Python worker at once. Texts can be long, and each worker and its executor hold a batch or two.
BATCH_ROWS = 2500
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHUFFLES_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, so that a lost executor loses nothing; dropped when no longer read.

    Lowers the rows of an Arrow batch to BATCH_ROWS for the session; results don't depend on it. The shuffle files of a
    table go once it is written, not when the driver next collects its garbage.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        if not 0 < int(spark.conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
            spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, before = scratch_path(self.spark, name), self.spark.conf.get(_SHUFFLES_SETTING)
        self.spark.conf.set(_SHUFFLES_SETTING, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_SHUFFLES_SETTING, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: bytes | None) -> list[bytes]:
    """Runs of characters other than U+0020 and U+0009..U+000D, with A-Z lower-cased."""
    return text.lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


# Constants of XXH64, and the length from which it goes by stripes.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_STRIPE = 32


def _rolled(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``word_hashes`` gives for the ``words`` of all texts, one text after the other, and where each text starts, and the end.

    Words of one length are hashed at once.
    """
    data = b"".join([b" ", b" ".join(texts).lower(), b" " * 9])
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 0x20) | (raw - np.uint8(9) < 5)
    bounds = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = bounds[::2], bounds[1::2] - bounds[::2]
    edges = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    classes = np.minimum(sizes, _STRIPE).astype(np.uint8)
    order, ends = np.argsort(classes, kind="stable"), np.cumsum(np.bincount(classes, minlength=_STRIPE))
    out, eight = np.empty(len(starts), np.uint64), np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    for n in range(1, _STRIPE):
        some = order[ends[n - 1] : ends[n]]
        if not len(some):
            continue
        at, done = starts[some], 0
        x = np.full(len(some), _P5 + np.uint64(n))
        for done in range(8, n + 1, 8):
            x = _rolled(x ^ (_rolled(eight[at + (done - 8)] * _P2, 31) * _P1), 27) * _P1 + _P4
        rest = eight[at + done] if n > done else None
        if n - done >= 4:
            x = _rolled(x ^ ((rest & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            done, rest = done + 4, rest >> np.uint64(32)
        for k in range(n - done):
            x = _rolled(x ^ (((rest >> np.uint64(8 * k)) & np.uint64(0xFF)) * _P5), 11) * _P1
        x ^= x >> np.uint64(33)
        x *= _P2
        x ^= x >> np.uint64(29)
        x *= _P3
        x ^= x >> np.uint64(32)
        out[some] = x
    for k in order[ends[_STRIPE - 1] :].tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return out, edges


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (public domain splitmix64 constants), one to one for each salt."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; of the whole sequence if it is shorter, none if it is empty."""
    width = min(width, len(hashes))
    if width == 0:
        return hashes
    last = len(hashes) - width + 1
    out = mix(hashes[:last], width)
    for k in range(1, width):
        out = mix(out * np.uint64(3) + hashes[k : k + last])
    return out


def binary(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a text column, one value at a time."""
    for value in batch.column(name).cast(pa.binary()):
        yield value.as_py()


def numbered(df: DataFrame, keys: list[str], order: list[Column], rows: int, name: str, per_task: int = 50_000) -> DataFrame:
    """Adds a gapless number from 0 within the keys, without bringing a key into one task.

    Rows are dealt over slices by the hash of their order columns; a slice is
    numbered alone and shifted by the rows of the slices before it.
    """
    slices = max(1, -(-rows // per_task))
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    counts = dealt.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order)) - 1
    joined = dealt.withColumn("_here", here).join(shifts, [*keys, "_slice"])
    return joined.withColumn(name, (F.col("_here") + F.col("_before")).cast("long")).drop("_slice", "_here", "_before")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for every node that has an edge.

    Large-star and small-star rounds: each node's neighbours are linked to the
    smallest among them, until nothing changes. A busy node is folded by partial
    aggregation and a join that adaptive execution splits; no group is collected.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links, state = scratch.keep(links, "links-0"), None
    for k in range(1, rounds + 1):
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        links = scratch.keep(small, f"links-{k}")
        scratch.drop(f"links-{k - 1}")
        before, state = state, links.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components not settled in {rounds} rounds")


def spans(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, or of one row."""
    start, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if k > start and size + n > most:
            yield batch.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows, one table for each value of the keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        if rest and any(rest[-1].column(k)[rest[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if start:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(start, end - start))
    if rest:
        yield pa.Table.from_batches(rest)


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until it is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


PLACES = 1 << 24


def place(column: str) -> Column:
    """Where a value stands in a ``bitmap``."""
    return F.pmod(F.xxhash64(column), F.lit(PLACES))


def bitmap(places: DataFrame) -> np.ndarray:
    """The places in the column ``at`` as packed bits: 2 MB, however many there are.

    It travels with tasks to leave out most rows that a later join drops; some that it lets through have no match there.
    """
    at = F.col("at") + 1
    parts = places.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    found = np.zeros(PLACES // 8, np.uint8)
    for r in parts.collect():  # at most 512 rows of 4 KB
        found[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return found


def marked(bits: np.ndarray, at: pa.Array) -> pa.Array:
    at = at.to_numpy()
    return pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1)


# Counting over the whole corpus, block by block. A block of documents asks for the counts of its own keys;
# a bucket, a range of the key space, adds up what all blocks have and answers each. A frequent key reaches
# its bucket once from each block, never once from each row, so no key makes a large group.

BLOCK_DDL = "block string, payload binary"
BUCKET_KEYS = 1_000_000


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """An array of unsigned numbers, compressed; ascending ones as differences. Bytes of one place stand together."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return bytes([values.itemsize, ascending]) + zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    size, ascending = data[0], data[1]
    planes = np.frombuffer(zstandard.decompress(data[2:]), np.uint8).reshape(size, -1)
    values = np.ascontiguousarray(planes.T).view(f"<u{size}").ravel()
    return np.cumsum(values, dtype=values.dtype) if ascending else values


def block_rows(payloads: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """A row for each payload, a tuple of arrays and other small values, in the columns of BLOCK_DDL."""
    for payload in payloads:
        data = zstandard.compress(pickle.dumps(payload, protocol=5), 1)
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([data], pa.binary())], ["block", "payload"])


def opened(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def bucket_bits(keys: int) -> int:
    """So many leading bits of a key name its bucket that one has about BUCKET_KEYS of so many keys."""
    return max(3, (max(1, keys) // BUCKET_KEYS).bit_length())


def totals_of(
    blocks: DataFrame,
    keys_of: Callable[[tuple], tuple[np.ndarray, np.ndarray]],
    bits: int,
    summary: Callable[[np.ndarray, np.ndarray], list[int]] | None = None,
    part: tuple[int, int] = (0, 1),
) -> DataFrame:
    """(block, bucket, totals): the sums over all blocks of the counts of each key of a block, in the order of its keys.

    ``keys_of`` makes sorted distinct 64-bit keys and their counts from a payload. With
    ``summary``, a row of block NULL holds its numbers for the keys and sums of a bucket.
    ``part`` (k, n) is for the buckets that are k modulo n: n tables, written in turn, hold what
    one would, and the shuffle files of one are gone before the next.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block"), batch.column("payload")):
                keys, counts = keys_of(opened(data.as_py()))
                edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                parts = zip(np.split(keys, edges), np.split(counts.astype(np.uint64), edges))
                rows = [(k, pack(a, True), pack(c)) for k, (a, c) in enumerate(parts) if len(a) and k % part[1] == part[0]]
                if rows:
                    bucket, keys, counts = zip(*rows)
                    columns = [pa.array([block.as_py()] * len(rows)), pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "keys", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(b) for b in group["keys"]]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(distinct), np.uint64)
        np.add.at(totals, at, np.concatenate([unpack(b) for b in group["counts"]]))
        parts = np.split(totals[at], np.cumsum([len(k) for k in keys])[:-1])
        rows = list(zip(group["block"], group["bucket"], map(pack, parts)))
        if summary is not None:
            rows.append((None, group["bucket"].iloc[0], pack(np.array(summary(distinct, totals), np.uint64))))
        return pd.DataFrame(rows, columns=["block", "bucket", "totals"])

    requests = blocks.mapInArrow(ask, "block string, bucket int, keys binary, counts binary")
    return requests.groupBy("bucket").applyInPandas(add, "block string, bucket int, totals binary")


def answered(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """Each block's payload followed by its totals; read it with ``by_block``."""
    own = blocks.select("block", F.lit(-1).alias("bucket"), F.col("payload").alias("data"))
    sent = totals.filter("block IS NOT NULL").select("block", "bucket", F.col("totals").alias("data"))
    return own.unionAll(sent).repartition("block").sortWithinPartitions("block", "bucket")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(payload, totals of all keys in order) of each block in the rows of ``answered``."""
    payload, parts = None, []
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
            if bucket >= 0:
                parts.append(unpack(data.as_py()))
                continue
            if payload is not None:
                yield opened(payload), np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.int64)
            payload, parts = data.as_py(), []
    if payload is not None:
        yield opened(payload), np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.int64)
