"""Spelling variants by Bloom-guided neighbourhoods.

The words of a vocabulary that differ by one inserted, deleted or replaced code point
are found by making, for each word, all words with one code point less and all with
one code point replaced by a later one of the alphabet; that reaches every pair once,
from its longer word or from the one with the earlier letter. The made words are not
written down: a polynomial hash follows each edit in a few operations, and is asked of
a blocked Bloom filter of the vocabulary, one filter for each length. What a filter
knows is spelled out and shuffled to an exact join with the vocabulary, which removes
the false positives.

Filters are broadcast in slices of at most ``SLICE`` bytes, one after the other, so a
vocabulary of any size is probed in passes of bounded size; a pass looks only at edits whose hash
belongs to its slice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, binary, mix

LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 7, 2, 10
# A filter has blocks of 512 bits, one for each BLOCK_WORDS words: 16 bits a word, 6 of them set.
BLOCK_WORDS, PROBES = 32, 6
EARLY = 3  # probes whose bits come with the block's; the others take a hash of their own
SLICE = 16 << 20
LONGEST = 48  # longer words share the last filter
HELD = 200_000  # words that a task holds before it passes on their counts
EDITS = 1 << 18  # edits that are probed at once
PIECE = 256  # blocks of a filter that are made together
PER_TASK = 20_000  # words that a task probes the edits of

# The runs that are words, A-Z being lower-cased before.
RUN = rb"(?:[a-z]|\xc3[\x80-\xbf])+"

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(count: int) -> np.ndarray:
    factors = np.full(count + 1, _BASE, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _letters(codes: np.ndarray) -> np.ndarray:
    """What stands for a code point in a hash; none is zero."""
    return mix(codes.astype(np.uint64), 7) | np.uint64(1)


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: their places, and a row of code points for each."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, np.frombuffer("".join(texts[k] for k in at).encode("utf-32-le"), np.uint32).reshape(len(at), length)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """The polynomial of each word's letters, lowest power first; equal words have equal hashes."""
    return (_letters(codes) * _powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def _shard(length: int) -> int:
    return min(length, LONGEST)


def _placed(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash among ``blocks``, from the upper half of its bits, and all of these."""
    spread = mix(hashes, 3)
    return ((spread >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), spread


def _probe(k: int, start: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of the table and the bit in it that the probe looks at."""
    bit = (source >> np.uint64(9 * (k % EARLY))) & np.uint64(511)
    return (start + (bit >> np.uint64(6))).astype(np.int64), bit & np.uint64(63)


def filter_of(hashes: np.ndarray, first: int, count: int, blocks: int) -> np.ndarray:
    """Blocks ``first`` to ``first + count`` of the filter of ``blocks`` blocks: 8 words of 64 bits each."""
    block, source = _placed(hashes, blocks)
    table = np.zeros(count * 8, np.uint64)
    start = (block - np.uint64(first)) * np.uint64(8)
    for k in range(PROBES):
        at, bit = _probe(k, start, source if k < EARLY else mix(source, 11))
        np.bitwise_or.at(table, at, np.uint64(1) << bit)
    return table


def known(hashes: np.ndarray, table: np.ndarray, first: int, blocks: int) -> np.ndarray:
    """The places of the hashes that the slice of the filter has, with few others."""
    block, source = _placed(hashes, blocks)
    at = np.arange(len(hashes))
    if len(table) < 8 * blocks:
        at = np.flatnonzero((block >= np.uint64(first)) & (block < np.uint64(first + len(table) // 8)))
        block, source = block[at], source[at]
    start = (block - np.uint64(first)) * np.uint64(8)
    for k in range(PROBES):
        if k == EARLY:  # few are left by now
            source = mix(source, 11)
        place, bit = _probe(k, start, source)
        held = np.flatnonzero((table[place] >> bit) & np.uint64(1))
        at, start, source = at[held], start[held], source[held]
    return at


def edits_known(texts: list[str], alphabet: np.ndarray, filters: dict[int, tuple[np.ndarray, int, int]]) -> Iterator[tuple[str, str]]:
    """(word, made): what a deletion or a replacement by a later letter makes of the words, as far as the filters know it."""
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    new = _letters(alphabet)
    for places, every in by_length(texts):
        length = every.shape[1]
        powers = _powers(length)[:length]
        step = max(1, EDITS // (length * len(alphabet)))
        for low in range(0, len(places), step):
            codes, own = every[low : low + step], places[low : low + step]
            terms = _letters(codes) * powers
            whole = terms.sum(axis=1, dtype=np.uint64)[:, None]
            if (shard := _shard(length - 1)) in filters:
                # What follows the deleted letter moves down by one power; of equal letters in a row one is enough.
                before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                first = np.ones(codes.shape, bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]
                row, k = np.nonzero(first)
                hashes = (before + (whole - before - terms) * inverse)[row, k]
                for e in known(hashes, *filters[shard]):
                    word, at = texts[own[row[e]]], int(k[e])
                    yield word, word[:at] + word[at + 1 :]
            if (shard := _shard(length)) in filters:
                width = max(1, EDITS // (len(own) * len(alphabet)))
                for left in range(0, length, width):
                    part = slice(left, left + width)
                    row, k, letter = np.nonzero(alphabet[None, None, :] > codes[:, part, None])
                    k += left
                    hashes = (whole - terms)[row, k] + new[letter] * powers[k]
                    for e in known(hashes, *filters[shard]):
                        word, at = texts[own[row[e]]], int(k[e])
                        yield word, word[:at] + chr(alphabet[letter[e]]) + word[at + 1 :]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, part: int | None = 31) -> DataFrame:
    """(word, n): words of at least ``least_length`` code points that occur ``least_count`` times or more.

    A run of letters loses one of them where ``part`` divides the checksum of the id and the run, ``None``
    leaves all as they are. A null id is empty there. Runs are counted by task, then over all.
    """
    runs = re.compile(RUN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), binary(batch, "text")):
                if not text:
                    continue
                prefix = zlib.crc32(b"%s:" % key.encode())
                for run, n in Counter(r for r in runs.findall(text.lower()) if len(r) >= least_length).items():
                    word = run.decode()
                    if len(word) < least_length:
                        continue
                    if part and (h := zlib.crc32(run, prefix)) % part == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield passed_on()
        yield passed_on()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def near_pairs(vocabulary: DataFrame, scratch: Scratch, slice_bytes: int = SLICE) -> DataFrame:
    """(word, other): every pair of near words of the vocabulary (word, …) in both orders.

    Words are distinct, not null and not empty. Filters of all passes together have two bytes for each word.
    """
    spark = vocabulary.sparkSession
    words = vocabulary.select("word")
    letters = words.select(F.explode(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).alias("letter")).distinct()
    found = [r.letter for r in letters.collect()]  # as many as Unicode has at most
    alphabet = np.array(sorted(map(ord, found)), np.uint32)
    shard = F.least(F.char_length("word"), F.lit(LONGEST)).alias("shard")
    sizes = {r.shard: r.n for r in words.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {s: -(-n // BLOCK_WORDS) for s, n in sorted(sizes.items())}
    if not blocks:
        return spark.createDataFrame([], "word string, other string")

    # A slice of a filter is made by one task; passes hold as many slices as fit, in order.
    most = max(1, slice_bytes // 64)
    piece = min(most, PIECE)
    pieces = [(s, low, min(piece, n - low)) for s, n in blocks.items() for low in range(0, n, piece)]
    passes: list[list[tuple[int, int, int]]] = [[]]
    for p in pieces:
        if sum(c for *_, c in passes[-1]) + p[2] > most:
            passes.append([])
        passes[-1].append(p)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in by_length(batch.column("word").to_pylist()):
                hashes, s = word_hashes(codes), _shard(codes.shape[1])
                at = _placed(hashes, blocks[s])[0].astype(np.int64) // piece
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), s, np.int32)), pa.array(at)], ["hash", "shard", "piece"])

    def built(group: pd.DataFrame) -> pd.DataFrame:
        s, k = int(group["shard"].iloc[0]), int(group["piece"].iloc[0])
        low = k * piece
        table = filter_of(group["hash"].to_numpy().view(np.uint64), low, min(piece, blocks[s] - low), blocks[s])
        return pd.DataFrame({"shard": [s], "piece": [k], "bits": [table.tobytes()]})

    tables = words.mapInArrow(placed, "hash long, shard int, piece long").groupBy("shard", "piece").applyInPandas(built, "shard int, piece long, bits binary")
    tables = scratch.keep(tables, "filters")

    positives = []
    for number, parts in enumerate(passes):
        own = {s: [(low, count) for t, low, count in parts if t == s] for s in {p[0] for p in parts}}
        ranges = [(F.col("shard") == s) & F.col("piece").between(q[0][0] // piece, q[-1][0] // piece) for s, q in own.items()]
        bits = {(r.shard, r.piece): r.bits for r in tables.filter(reduce(or_, ranges)).collect()}  # at most slice_bytes
        filters = {}
        for s, q in own.items():
            table = [np.frombuffer(bits.get((s, low // piece), bytes(64 * count)), np.uint64) for low, count in q]
            filters[s] = (np.concatenate(table), q[0][0], blocks[s])
        sent = spark.sparkContext.broadcast((alphabet, filters))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(edits_known(batch.column("word").to_pylist(), *sent.value))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], ["word", "other"])

        dealt = words.repartition(max(1, sum(sizes.values()) // PER_TASK))
        positives.append(scratch.keep(dealt.mapInArrow(probe, "word string, other string"), f"positives-{number}"))
        sent.destroy()
    scratch.drop("filters")
    exact = reduce(DataFrame.unionAll, positives).join(words.withColumnRenamed("word", "other"), "other", "left_semi")
    exact = scratch.keep(exact.select("word", "other"), "near")
    scratch.drop(*[f"positives-{k}" for k in range(len(passes))])
    return exact.unionAll(exact.select(F.col("other").alias("word"), F.col("word").alias("other")))


def variants(vocabulary: DataFrame, scratch: Scratch, least_ratio: int = LEAST_RATIO, slice_bytes: int = SLICE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    The form of a word is its near word of largest n, of several the first in code-point order, if
    that n is ``least_ratio`` times the word's or more; the root is where the forms lead. As n grows by that ratio
    with every form, at most log(largest n) of them follow one another, and each round below doubles
    the way. An empty vocabulary gives no rows.
    """
    if least_ratio < 2:
        raise ValueError("least_ratio must be at least 2, so that forms lead to an end")
    vocabulary = scratch.keep(vocabulary.select("word", "n"), "vocabulary")
    other = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), F.col("other")))
    pairs = near_pairs(vocabulary, scratch, slice_bytes).join(other, "other")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    sure = F.col("best.other_n") >= least_ratio * F.col("n")
    words = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(sure, F.col("best.other")).alias("form"), F.when(sure, F.col("best.other_n")).alias("form_n")
    )
    words = scratch.keep(words, "forms")
    steps = scratch.keep(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, 64):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = steps.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = scratch.keep(moved, f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
        steps = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    return words.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
