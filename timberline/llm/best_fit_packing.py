"""Best-fit packing of token sequences, large pieces first.

A document's ids are cut into pieces of at most the capacity. Packing needs only
how many pieces there are of each length, so it is worked out on that histogram
(at most ``capacity`` counts, whatever the corpus) and handed out by a piece's
rank among those of its length:

1. Large-item matching: of pieces over a third of the capacity, at most two fit a
   sequence. From the largest down, each is matched with the largest that still
   fits beside it.
2. Smaller pieces, longest first, each enter the sequence with the tightest gap
   that holds them.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch, numbered, spans

END = 2
CACHE = 200_000  # words kept per Python worker, about 50 MB; a worker keeps them through later stages too
LONG = 32  # characters; longer chunks, whole texts among them, seldom come again and are not kept

_SPACED = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_LATIN = chr(0x250)  # letters below it are letters in any version of Unicode
_OTHER_SPACE = re.compile(r"[^\S \t\n\r]")


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, with the words' ids remembered.

    A byte-level pattern takes white space only at the start of a match, so a text
    may be cut before each run of white space and its chunks encoded alone. Texts
    where that is not certain (a special token, rare white space) are encoded whole.
    Given the same vocabulary as ranks, chunks of Latin letters go through a faster
    library, which has the same ids for them.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens", [])]
        self.known: dict[str, bytes] = {}
        self.fast = None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Made when a chunk first needs it, as it takes about 30 MB."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        parts, known = self._chunks(text), self.known
        added = new = list({c for c in parts if c not in known})
        if self.fast is not None:
            encode = self.fast.encode_ordinary
            known.update((c, array("I", encode(c)).tobytes()) for c in new if c and max(c) < _LATIN and self._plain(c))
            new = [c for c in new if c not in known]
        for start in range(0, len(new), 10_000):
            part = new[start : start + 10_000]
            known.update(zip(part, self._whole(part)))
        out = b"".join(map(known.__getitem__, parts))
        for c in added:
            if len(c) > LONG:
                del known[c]
        if len(known) > CACHE:
            known.clear()
        return out

    def _plain(self, text: str) -> bool:
        return not any(s in text for s in self.special) and not _OTHER_SPACE.search(text)

    def _chunks(self, text: str) -> list[str]:
        return _SPACED.findall(text) if self._plain(text) else [text]


_ENCODERS: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = Encoder(path, ranks)
    return _ENCODERS[path, ranks]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end: int = END, ranks: str | None = None
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece; the first piece of a long document is the shorter one.

    The ids of a text are followed by ``end``; a null text counts as empty. ``tokenizer``
    and ``ranks``, the same vocabulary as ranks, are paths that every executor can read.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            for part in spans(batch, "text", 1 << 20):
                out = []
                for id_, data in zip(part.column("_id"), encode(part.column("text").to_pylist())):
                    data, id_ = data + tail, id_.as_py()
                    n, at = len(data) // 4, 0
                    for k in range(-(-n // capacity)):
                        length = (n - 1) % capacity + 1 if k == 0 else capacity
                        out.append((id_, k, at, length, crc32(data[4 * at : 4 * (at + length)])))
                        at += length
                columns = list(zip(*out))
                kinds = [batch.column("_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["_id", "piece", "start", "length", "ids_crc32"]
                )

    kind = f"_id {dict(source.dtypes)['_id']}, piece int, start long, length long, ids_crc32 long"
    return source.mapInArrow(cut, kind).withColumnRenamed("_id", id_col)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, the lengths in one of them), from the number of pieces of each length."""
    left = {n: c for n, c in histogram.items() if c}
    out: Counter[tuple[int, ...]] = Counter()
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        k = bisect_left(large, capacity - n + 1) - 1
        if k >= 0 and large[k] == n and left[n] == 1:
            k -= 1  # it can't stand beside itself
        used = (n, large[k]) if k >= 0 else (n,)
        times = left[n] // (2 if used == (n, n) else 1)
        if k >= 0 and large[k] != n:
            times = min(times, left[large[k]])
        out[used] += times
        for m in used:
            left[m] -= times
        large = [n for n in large if left[n]]
    by_gap: dict[int, Counter[tuple[int, ...]]] = {}
    for used, times in out.items():
        by_gap.setdefault(capacity - sum(used), Counter())[used] += times
    gaps = sorted(by_gap)

    def put(used: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(used)
        if gap not in by_gap:
            by_gap[gap] = Counter()
            insort(gaps, gap)
        by_gap[gap][used] += times

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                # A new sequence takes as many of this length as fit; they would all choose it.
                each = min(capacity // n, left[n])
                times = left[n] // each
                put((n,) * each, times)
                left[n] -= each * times
                continue
            gap = gaps[k]
            used, times = next(iter(by_gap[gap].items()))
            times = min(times, left[n])
            by_gap[gap][used] -= times
            if not by_gap[gap][used]:
                del by_gap[gap][used]
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(k)
            put((*used, n), times)
            left[n] -= times
    return [(times, used) for gap in sorted(by_gap) for used, times in sorted(by_gap[gap].items())]


def pack(
    docs: DataFrame,
    scratch: Scratch,
    tokenizer: str,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str | None = None,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null or empty text is the end id alone. Rows with null or repeated ids are
    documents like any other; an empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    cut = scratch.keep(pieces(docs, tokenizer, capacity, id_col, text_col, ranks=ranks).withColumnRenamed(id_col, "_id"), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    # For each length, where ranks start, and the sequence and offset of the first piece of each stretch.
    stretches: dict[int, list[tuple[int, int, int]]] = {n: [] for n in counts}
    given, base = Counter(), 0
    for times, used in plan(counts, capacity):
        offset = 0
        for n in used:
            stretches[n].append((given[n], base, offset))
            given[n] += times
            offset += n
        base += times
    lookup = {n: np.array(rows, np.int64).T for n, rows in stretches.items()}

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                own = lengths == n
                starts, bases, offsets = lookup[int(n)]
                k = np.searchsorted(starts, ranks[own], "right") - 1
                sequence[own] = bases[k] + ranks[own] - starts[k]
                offset[own] = offsets[k]
            columns = [batch.column(c) for c in ("_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    order = [F.col(c) for c in ("_id", "piece", "ids_crc32", "start")]
    ranked = numbered(cut, ["length"], order, sum(counts.values()), "rank")
    return ranked.mapInArrow(hand_out, f"_id {dict(cut.dtypes)['_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("_id", id_col)
