"""Substring dedup by compact windows.

A text is its sequence of five-word shingles. For a hash function, the compact window
of a position is the widest stretch in which its hash is the smallest; all stretches
of at least the passage length fall into few such windows, the nodes of a Cartesian
tree. Two texts that share a passage have windows of equal least hash around it.

1. Exact repeats: around the centre of each window stand a few runs, at offsets in
   steps of eight, one of which lies inside any passage of full length that has this
   centre. Runs that occur in several documents are repeats. So every passage of at
   least ``passage`` words that stands in two documents is found, and none of fewer
   than ``passage - 8`` words.
2. Near repeats: where windows of two functions overlap by the passage length and
   other documents have the same two least hashes, the stretches are compared, all that
   two documents have at once, with the first document that has the hashes and then with
   the other earlier ones in turn, until one has a stretch of Jaccard similarity 0.8 or
   more, at whatever offset; such stretches are repeats.

Each repeat is credited to its first document in the order of ids, which keeps it.
"""

from __future__ import annotations

import operator
import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import (
    BLOCK_DDL,
    Scratch,
    answered,
    binary,
    bitmap,
    block_rows,
    bucket_bits,
    by_block,
    fresh,
    hashed_words,
    marked,
    mix,
    opened,
    pack,
    place,
    shingles,
    spans,
    totals_of,
    unpack,
)

WIDTH, PASSAGE = 5, 50
STEP = 8
FUNCTIONS = 4
PART, WHOLE = 80, 100
BLOCK_BYTES = 4 << 20
MEMBERS = 2048
GRAMS = 16 << 20
POSTED = 1 << 20
TILE = 64
ROUNDS = 32
_BASE = 0x9FB21C651E98DF25  # odd
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_RUN, _LEAST = np.uint64(1), ~np.uint64(1)


def compact_windows(hashes: np.ndarray, least: int, edges: np.ndarray | None = None) -> np.ndarray:
    """Rows (from, centre, to) of the windows of at least so many positions, by centre: a Cartesian tree without its small nodes.

    ``edges``, if given, are where each of several texts starts, and the end; no window crosses them. Of equal hashes
    the first is the centre. What is least in a stretch of ``least`` is a candidate; the smaller hashes that bound a
    candidate's window are candidates too, so these, a few in a hundred, are enough to find all windows.
    """
    edges = np.array([0, len(hashes)]) if edges is None else edges
    if len(hashes) < least:
        return np.zeros((0, 3), np.uint32)
    low = _over(np.minimum, hashes, least)
    inside = np.repeat(edges[1:], np.diff(edges))[: len(low)] - np.arange(len(low)) >= least
    low[~inside] = 0
    most = _over(np.maximum, np.concatenate([np.zeros(least - 1, np.uint64), low, np.zeros(least - 1, np.uint64)]), least)
    at = np.flatnonzero(most == hashes)
    # Before each text and after the last stands what bounds all.
    stops = np.searchsorted(at, edges) + np.arange(len(edges))
    inner = np.ones(len(at) + len(edges), bool)
    inner[stops] = False
    own, values, places = np.flatnonzero(inner), np.zeros(len(inner), np.uint64), np.empty(len(inner), np.int64)
    values[own], places[own], places[stops] = hashes[at], at, edges - 1
    left = places[_bounds(values, inner, -1, operator.gt)] + 1
    places[stops] = edges
    right = places[_bounds(values, inner, 1, operator.ge)]
    wide = right - left >= least
    return np.stack([left[wide], at[wide], right[wide]], axis=1).astype(np.uint32)


def _bounds(values: np.ndarray, inner: np.ndarray, step: int, larger: Callable) -> np.ndarray:
    """For each ``inner`` place the nearest in one direction (``step`` 1 or -1) that is not larger, or not inner: from a larger one it goes on to the bound of that."""
    own = np.flatnonzero(inner)
    bound, open_, next_ = np.arange(len(values)) + step, own, own + step
    for _ in range(ROUNDS):
        on = larger(values[next_], values[open_]) & inner[next_]
        open_, next_ = open_[on], bound[next_[on]]
        if not len(open_):
            return bound[own]
        bound[open_] = next_
    # Long rows of bounds, as of equal values: in turn and from the next place on, so that each is gone over once.
    known, all_, ends = bound.tolist(), values.tolist(), (~inner).tolist()
    for k in open_.tolist()[::-step]:
        n = k + step
        while not ends[n] and larger(all_[n], all_[k]):
            n = known[n]
        known[k] = n
    return np.array(known)[own]


def _over(function: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or the largest of each stretch of ``width`` values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = function(out[:-step], out[step:])
        done += step
    return out.copy() if width == 1 else out


def run_starts(centres: np.ndarray, count: int, least: int, since: np.ndarray | int = 0, until: np.ndarray | None = None) -> np.ndarray:
    """Starts of the runs around the centres that lie within the text, or within each centre's own (``since``, ``until``)."""
    starts = centres.astype(np.int64)[:, None] - np.arange(0, least, STEP)[None, :]
    since, until = (np.asarray(x)[..., None] for x in (since, count if until is None else until))
    return _different(starts[(starts >= since) & (starts + least - STEP <= until)])


def run_hashes(grams: np.ndarray, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Odd hashes of the runs of so many shingles."""
    powers = np.cumprod(np.full(len(grams), _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams * powers)])
    back = np.cumprod(np.full(len(grams), _INVERSE, np.uint64))
    return mix((sums[starts + length] - sums[starts]) * back[starts], 1) | _RUN


def _different(a: np.ndarray) -> np.ndarray:
    """The different values in order; quicker than ``np.unique``, which puts them into a hash table first."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return a[new]


def _distinct(a: np.ndarray, least: int, different: int | None = None) -> np.ndarray:
    """How many different shingles each stretch of ``least`` has; ``different``, if known, is how many all of them are."""
    if (len(_different(a)) if different is None else different) == len(a):
        return np.full(len(a) - least + 1, least)
    order = np.argsort(a, kind="stable")
    before = np.full(len(a), -1)
    same = a[order[1:]] == a[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return (np.lib.stride_tricks.sliding_window_view(before, least) < np.arange(len(a) - least + 1)[:, None]).sum(axis=1)


def _holds(a: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Which of the common shingles each stretch of ``least`` has, as ones and zeros."""
    at = np.searchsorted(common, a)
    at[at == len(common)] = 0
    seen = np.zeros((len(a) + 1, len(common)), np.float32)
    known = np.flatnonzero(common[at] == a)
    seen[known + 1, at[known]] = 1
    counts = np.cumsum(seen, axis=0)
    return (counts[least:] > counts[:-least]).astype(np.float32)


def side(a: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's shingles, the different ones, and how many of them each stretch has: what a comparison asks of either side."""
    return a, np.unique(a), _distinct(a, least)


def alike(one: tuple, two: tuple, least: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of the first ``side`` of ``least`` shingles that are similar to any stretch of the second that wide, at whatever offset."""
    (a, all_a, own), (b, all_b, other) = one, two
    common = np.intersect1d(all_a, all_b, assume_unique=True)
    # Similar stretches share this much of the larger one.
    if WHOLE * len(common) < PART * max(own.min(), other.min()):
        return []
    shared = _holds(a, common, least) @ _holds(b, common, least).T
    similar = WHOLE * shared >= PART * (own[:, None] + other[None, :] - shared)
    return [(s, s + least) for s in np.flatnonzero(similar.any(axis=1)).tolist()]


def _parts(edges: np.ndarray, least: int) -> np.ndarray:
    """Which stretches of ``least`` lie within one of the parts that end at ``edges``."""
    if len(edges) == 2:
        return np.ones(int(edges[1]) - least + 1, bool)
    until = np.repeat(edges[1:], np.diff(edges))
    return until[: len(until) - least + 1] - np.arange(len(until) - least + 1) >= least


def alike_parts(one: tuple, two: tuple, least: int) -> np.ndarray:
    """What ``alike`` finds, as starts, between texts of several parts each: (shingles, edges of the parts, ``_distinct``, the different ones, ``_parts`` if known)."""
    (a, edges_a, own, all_a, *within_a), (b, edges_b, other, all_b, *within_b) = one, two
    none = np.zeros(0, np.int64)
    common = np.intersect1d(all_a, all_b, assume_unique=True)
    least_a, least_b = int(own.min()), int(other.min())
    if WHOLE * len(common) < PART * max(least_a, least_b) or (WHOLE + PART) * len(common) < PART * (least_a + least_b):
        return none
    places = []
    for x, edges, distinct, within, floor in ((a, edges_a, own, within_a, least_b), (b, edges_b, other, within_b, least_a)):
        at = np.searchsorted(common, x)
        at[at == len(common)] = 0
        known = common[at] == x
        counts = np.zeros(len(x) + 1, np.int64)
        np.cumsum(known, out=counts[1:])
        enough = (WHOLE + PART) * (counts[least:] - counts[:-least]) >= PART * (distinct + floor)
        enough = np.flatnonzero(enough & (within[0] if within else _parts(edges, least)))
        if not len(enough):
            return none
        places.append((at, known, enough))
    (at_a, known_a, some), (at_b, known_b, others) = places
    # Only what lies in such stretches counts from here on.
    known_a, known_b = (k & _covering(x, len(k), least) for k, x in ((known_a, some), (known_b, others)))
    p, q = np.flatnonzero(known_a), np.flatnonzero(known_b)
    if len(p) and len(q) and np.bincount(at_a[p]).max() == 1 and np.bincount(at_b[q]).max() == 1:
        there = np.full(len(common), -1)
        there[at_b[q]] = q
        q = there[at_a[p]]
        p, q = p[q >= 0], q[q >= 0]
        if (q[1:] > q[:-1]).all() and (own[some] == least).all() and (other[others] == least).all():
            need = -(-PART * 2 * least // (WHOLE + PART))
            if len(q) < need:
                return none
            part = np.searchsorted(edges_b, q, side="right")
            tight = (q[need - 1 :] - q[: len(q) - need + 1] < least) & (part[need - 1 :] == part[: len(q) - need + 1])
            counts = np.concatenate([[0], np.cumsum(tight)])
            first, last = np.searchsorted(p, some), np.searchsorted(p, some + least) - need + 1
            some, first, last = (x[last > first] for x in (some, first, last))
            return some[counts[last] > counts[first]]
    # Tiles of stretches whose shingles have too little in common hold no similar ones.
    tiles = []
    for at, known, starts in ((at_a, known_a, some), (at_b, known_b, others)):
        parts = np.split(starts, range(TILE, len(starts), TILE))
        has = np.zeros((len(parts), len(common)), np.float32)
        for k, part in enumerate(parts):
            here = slice(part[0], part[-1] + least)
            has[k, at[here][known[here]]] = 1
        tiles.append((parts, has))
    (parts_a, has_a), (parts_b, has_b) = tiles
    near = WHOLE * (has_a @ has_b.T) >= PART * max(own[some].min(), other[others].min())
    similar = [np.zeros(len(x), bool) for x in parts_a]
    for k, m in np.argwhere(near).tolist():
        if not similar[k].all():
            held, mine, theirs = common[(has_a[k] > 0) & (has_b[m] > 0)], parts_a[k], parts_b[m]
            shared = _holds_at(a, held, mine, least) @ _holds_at(b, held, theirs, least).T
            similar[k] |= (WHOLE * shared >= PART * (own[mine][:, None] + other[theirs][None, :] - shared)).any(axis=1)
    return some[np.concatenate(similar)]


def _covering(starts: np.ndarray, count: int, least: int) -> np.ndarray:
    """Which of so many positions lie in a stretch of ``least`` from one of the starts."""
    steps = np.bincount(starts, minlength=count + 1)[: count + 1] - np.bincount(starts + least, minlength=count + 1)[: count + 1]
    return np.cumsum(steps)[:count] > 0


def _holds_at(a: np.ndarray, common: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Which of the common shingles each stretch of ``least`` from the starts has, as ones and zeros."""
    base = starts[0]
    a = a[base : starts[-1] + least]
    at = np.searchsorted(common, a)
    at[at == len(common)] = 0
    at[common[at] != a] = len(common)
    out = np.zeros((len(starts), len(common) + 1), np.float32)
    out[np.arange(len(starts))[:, None], at[(starts - base)[:, None] + np.arange(least)]] = 1
    return out[:, :-1]


def _joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping stretches put together."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def _payloads(batches: Iterator[pa.RecordBatch], least: int, width: int, block_bytes: int) -> Iterator[tuple]:
    """(rows, ids, edges, starts of runs, their hashes, windows of each function, their least hashes) of texts of bounded bytes.

    Texts stand one after the other; ``edges`` are where each starts, and the end.
    """
    for whole in batches:
        for batch in spans(whole, "text", block_bytes):
            hashes, edges = hashed_words([t or b"" for t in binary(batch, "text")])
            many = np.diff(edges) - width + 1
            some = np.flatnonzero(many >= least)
            if not len(some):
                continue
            rows, ids = (batch.column(c).take(pa.array(some)).to_pylist() for c in ("row", "id"))
            # Shingles of two texts are left out.
            grams = shingles(hashes, width)[_ranges(edges[some], edges[some] + many[some])]
            edges = np.concatenate([[0], np.cumsum(many[some])])
            windows, lows = [], []
            for f in range(FUNCTIONS):
                hashes = mix(grams, f + 2)
                windows.append(compact_windows(hashes, least, edges))
                # Least hashes are small numbers; mixed, they go to all buckets alike.
                lows.append(pack(mix(hashes[windows[-1][:, 1]]) & _LEAST))
            centres = windows[0][:, 1]
            of = np.searchsorted(edges, centres, side="right")
            starts = run_starts(centres, len(grams), least, edges[of - 1], edges[of])
            runs = pack(run_hashes(grams, starts, least - STEP))
            yield rows, ids, edges, pack(starts.astype(np.uint32), True), runs, [_narrow(w) for w in windows], lows


def _narrow(windows: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Centres, and how far the windows reach before and after them."""
    start, centre, stop = np.ascontiguousarray(windows.T)
    return pack(centre, True), pack(centre - start), pack(stop - centre)


def _wide(data: tuple[bytes, bytes, bytes]) -> np.ndarray:
    centre, before, after = (unpack(x).astype(np.int64) for x in data)
    return np.stack([centre - before, centre, centre + after], axis=1)


def _counts(payload: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([unpack(payload[4]), *map(unpack, payload[6])]), return_counts=True)


_FOUND = "kind int, key long, row long, id long, start int, stop int, block long, doc int, payload binary"
_FOUND_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _shared(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Runs that occur more than once (kind 0), and for each block the windows whose least hash does (kind 1)."""
    names = [f.split()[0] for f in _FOUND.split(", ")]
    for (rows, ids, edges, starts, runs, windows, lows), totals in by_block(batches):
        block = uuid.uuid4().int >> 65
        starts, runs, lows = unpack(starts).astype(np.int64), unpack(runs), [unpack(x) for x in lows]
        keys = _different(np.concatenate([runs, *lows]))
        own = np.flatnonzero(totals[np.searchsorted(keys, runs)] > 1)
        doc = np.searchsorted(edges, starts[own], side="right").astype(np.int32) - np.int32(1)
        if len(own):
            # Equal runs one word apart are of one shingle; such ones make one row.
            new = np.ones(len(own), bool)
            new[1:] = (runs[own[1:]] != runs[own[:-1]]) | (starts[own[1:]] != starts[own[:-1]] + 1) | (doc[1:] != doc[:-1])
            last = own[np.append(np.flatnonzero(new)[1:], len(own)) - 1]
            own, doc = own[new], doc[new]
            row, id_ = (pa.array(x, pa.int64()).take(pa.array(doc)) for x in (rows, ids))
            start, stop = ((x - edges[doc]).astype(np.int32) for x in (starts[own], starts[last] + (least - STEP)))
            columns = [np.zeros(len(own), np.int32), runs[own].view(np.int64), row, id_, start, stop, np.full(len(own), block), doc, pa.nulls(len(own), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)
        # Centres inside repeated runs count as well: an edited copy may have its only partners there.
        again = [totals[np.searchsorted(keys, x)] > 1 for x in lows]
        if any(x.any() for x in again):
            kept = [_narrow(_wide(w)[x].astype(np.uint32)) for w, x in zip(windows, again)]
            data = pickle.dumps((rows, ids, edges, kept, [pack(low[x]) for low, x in zip(lows, again)]), protocol=5)
            columns = [[1], *[[None]] * 5, [block], [None], [zstandard.compress(data, 1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FOUND_TYPES)], names)


_COVERED = "block long, covered binary, row long, id long, first_id long, start int, stop int"


def _covered(group: pa.Table, length: int) -> pa.Table:
    """The stretches of each text of a block that stand, in one piece, in the same earlier text, and its repeats put together."""
    doc, first, since, start, stop = (group.column(c).to_numpy() for c in ("doc", "first_row", "first_start", "start", "stop"))
    order = np.lexsort((start, since - start, first, doc))
    doc, first, shift, start, stop = doc[order], first[order], (since - start)[order], start[order].astype(np.int64), stop[order]
    other = np.ones(len(group), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])
    # Of runs of one shingle, which may be fewer in the earlier text, the first. All have one length, so the one before reaches farthest.
    new = other.copy()
    new[1:] |= (shift[1:] != shift[:-1]) | (start[1:] > start[:-1] + length)
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(group)) - 1
    whole = np.stack([doc[at], start[at], start[ends] + length]).astype(np.uint32)
    # Here runs of one shingle count as far as they go, at whatever shift.
    which = np.cumsum(other)
    again = np.lexsort((start, which))
    places = np.stack([start[again], stop[again]], axis=1) + (which[again] * (int(stop.max()) + 1))[:, None]
    first, last = _united(places)
    first, last = order[again[first]], order[again[last]]
    rows = group.take(pa.array(first))
    columns = [rows.column(c) for c in ("row", "id", "first_id", "start")] + [group.column("stop").take(pa.array(last))]
    none = pa.nulls(len(first), pa.binary())
    found = pa.table([rows.column("block"), none, *columns], names=[c.split()[0] for c in _COVERED.split(", ")])
    mark = [rows.column("block")[:1], pa.array([pack(whole.ravel())], pa.binary()), *(pa.nulls(1, c.type) for c in columns)]
    return pa.concat_tables([found, pa.table(mark, names=found.column_names)])


def _stretches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, row, id, places): the stretches that each text has under a pair of least hashes, start and stop of each in turn.

    Stretches that stand in an earlier text word for word are left out: that text has them under the same key.
    """
    for batch in batches:
        for data, covers in zip(batch.column("payload"), batch.column("covered")):
            rows, ids, edges, windows, lows = opened(data.as_py())
            windows, lows = [_wide(w) for w in windows], [unpack(x) for x in lows]
            covers = unpack(covers.as_py()).reshape(3, -1).astype(np.int64) if covers.is_valid else np.zeros((3, 0), np.int64)
            since, until = covers[1:] + edges[covers[0]]
            order = np.argsort(since, kind="stable")
            since, until = since[order], np.maximum.accumulate(until[order]) if len(order) else until
            row, id_ = pa.array(rows, pa.int64()), pa.array(ids, pa.int64())
            for f in range(len(windows)):
                for g in range(f + 1, len(windows)):
                    found, low, high, even = _pairs(windows[f], lows[f], windows[g], lows[g], f, g, least)
                    if len(since):
                        k = np.searchsorted(since, low, side="right") - 1
                        open_ = (k < 0) | (until[k] < high)
                        found, low, high, even = found[open_], low[open_], high[open_], even[open_]
                    if len(found):
                        # All stretches of one shingle are one set, and one place.
                        new = np.ones(len(found), bool)
                        new[1:] = ~(even[1:] & even[:-1]) | (found[1:] != found[:-1]) | (low[1:] != low[:-1] + 1)
                        at = np.flatnonzero(new)
                        found, low, high = found[at], low[at], high[np.append(at[1:], len(new)) - 1]
                        doc = np.searchsorted(edges, low, side="right") - 1
                        first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]))
                        places = np.stack([low - edges[doc], high - edges[doc]], axis=1).astype(np.int32).ravel()
                        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(found)).astype(np.int32) * 2, pa.int32()), pa.array(places))
                        at = pa.array(doc[first])
                        for k in range(0, len(first), 10_000):
                            yield pa.RecordBatch.from_arrays([pa.array(found[first[k : k + 10_000]]), *(x.slice(k, 10_000) for x in (row.take(at), id_.take(at), places))], ["key", "row", "id", "places"])


def _chains(windows: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows start at their centre, and for each the first and the last centre of those of one shingle that follow one another there."""
    centres = windows[:, 1]
    tight = windows[:, 0] == centres
    new = np.ones(len(windows), bool)
    new[1:] = ~(tight[1:] & tight[:-1]) | (centres[1:] != centres[:-1] + 1) | (lows[1:] != lows[:-1])
    at, which = np.flatnonzero(new), np.cumsum(new) - 1
    return tight, centres[at][which], centres[np.append(at[1:], len(new)) - 1][which]


def _pairs(one: np.ndarray, lows_one: np.ndarray, two: np.ndarray, lows_two: np.ndarray, f: int, g: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, stop, even) of the stretches of at least so many positions in a window of each of two functions, once each, by key and start.

    What is ``even`` has ``least`` times one shingle.
    """
    if not len(one) or not len(two):
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    centres, own = two[:, 1], one[:, 1]
    (tight, _, last), (tight_two, since, until) = _chains(one, lows_one), _chains(two, lows_two)
    first, stop = np.searchsorted(centres, own - least + 1), np.searchsorted(centres, own + least)
    # Where one shingle repeats, two windows give what those of both functions at the later centre give.
    same = np.minimum(np.searchsorted(centres, own), len(two) - 1)
    both = tight & tight_two[same] & (centres[same] == own)
    common = np.minimum(last, until[same])
    skip = np.where(both, np.maximum(first, same - (own - since[same])), stop)
    after = np.where(both, np.minimum(stop, same + (common - own) + 1), stop)
    k = np.concatenate([np.repeat(np.arange(len(one)), skip - first), np.flatnonzero(both), np.repeat(np.arange(len(one)), stop - after)])
    j = np.concatenate([_ranges(first, skip), same[both], _ranges(after, stop)])
    even = np.zeros(len(k), bool)
    even[(skip - first).sum() :][: both.sum()] = (common - own >= least - 1)[both]
    parts = []
    for at in range(0, len(k), 1 << 18):
        some, other, flat = (x[at : at + (1 << 18)] for x in (k, j, even))
        (l1, c1, r1), (l2, c2, r2) = one[some].T, two[other].T
        low = np.maximum(np.maximum(l1, l2), np.minimum(c1, c2) - least)
        high = np.minimum(np.minimum(r1, r2), np.maximum(c1, c2) + least)
        wide = high - low >= least
        parts.append((mix(mix(lows_one[some[wide]], f) + lows_two[other[wide]], g).view(np.int64), low[wide], high[wide], flat[wide]))
    if not parts:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    keys, low, high, even = (np.concatenate(x) for x in zip(*parts))
    # In a text that repeats itself, many windows give one stretch.
    order = np.lexsort((low * (3 * least + 1) + (high - low), keys))  # a stretch ends at most 3 * least after its start
    keys, low, high, even = keys[order], low[order], high[order], even[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return keys[new], low[new], high[new], even[new]


def _ranges(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    many = stop - first
    return np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)


def _order() -> Column:
    # A NULL id comes last, as the largest number.
    return F.coalesce("id", F.lit((1 << 63) - 1))


def _copies(docs: DataFrame) -> DataFrame:
    """(row, id, first_row) of the documents whose whole text is that of an earlier one."""
    texts = docs.select("row", "id", F.xxhash64("text").alias("same"))
    first = texts.groupBy("same").agg(F.min(F.struct(_order(), "row")).alias("first"), F.min("row").alias("low"), F.max("row").alias("high"))
    first = first.filter("low <> high").select("same", F.col("first.row").alias("first_row"))
    return texts.join(first, "same").filter("row <> first_row").select("row", "id", "first_row").distinct()


def _credited(found: DataFrame) -> DataFrame:
    """Each occurrence of a key in another document than its first, with the place of the first."""
    order = F.struct(_order(), "row", "start", "stop", "id")
    first = found.groupBy("key").agg(F.min(order).alias("first"), F.max("row").alias("high"), F.min("row").alias("low"))
    first = first.filter("low <> high").select(
        "key", F.col("first.row").alias("first_row"), F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")
    )
    return found.join(first, "key").filter("row <> first_row")


def _prefixes(sides: list[tuple], least: int) -> list[np.ndarray]:
    """Of the shingles of each stretch so many, rarest first, that two similar stretches have one in common."""
    sets = [own for _, own, _ in sides]
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = []
    for (_, own, distinct), ranks in zip(sides, np.split(at, np.cumsum([len(x) for x in sets])[:-1])):
        # What is similar to so many different shingles has this many of them.
        common = -(-PART * int(distinct.min()) // WHOLE)
        out.append(ranks[np.lexsort((ranks, counts[ranks]))[: len(own) - common + 1]])
    return out


# Shingles of near stretches travel as 32 bits: two of a compared pair of stretches that differ are taken for one with a chance of 5e-7.
_GRAM = np.uint32


def _meeting(sides: list[tuple], least: int, asking: list[tuple | None] | None = None) -> Iterator[list[int]]:
    """For each side in turn the earlier ones that may have a similar stretch: a rare shingle in common.

    ``asking``, if given, has what is asked for in the place of each side, or None.
    """
    asked = [x for x in asking or [] if x is not None]
    prefixes = [x.tolist() for x in _prefixes([*sides, *asked], least)]
    rest, posted = iter(prefixes[len(sides) :]), {}
    for p, prefix in enumerate(prefixes[: len(sides)]):
        own = prefix if asking is None else next(rest) if asking[p] is not None else []
        yield sorted({d for g in own for d in posted.get(g, ())})
        for g in prefix:
            posted.setdefault(g, []).append(p)


def _earlier(items: list[tuple], least: int) -> Iterator[tuple]:
    """Of (order, shingles), contents under one key: (place, place of the first in order that is similar, stretches), where that comes before it."""
    order = sorted(range(len(items)), key=lambda k: items[k][0])
    sides = [side(np.frombuffer(items[k][1], _GRAM), least) for k in order]
    for p, others in enumerate(_meeting(sides, least)):
        for d in others:
            if stretches := alike(sides[p], sides[d], least):
                yield order[p], order[d], _joined(stretches)
                break


_TEXTS = "first_row long, i int, j int, order long, row long, id long, keys binary, places binary, parts binary, grams binary"
_TEXT_TYPES = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 4]
_FINDS = "key long, place long, row long, id long, better struct<order:long,row:long,id:long>, spans array<struct<start:int,stop:int>>"
_FIND_TYPES = [*[pa.int64()] * 4, pa.struct([("order", pa.int64()), ("row", pa.int64()), ("id", pa.int64())]), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]


def _texts(batches: Iterator[pa.RecordBatch], least: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, text, held), ``held`` what a text has together with each first text, to the shingles there, once for each first text.

    ``parts`` are where these shingles stand, as (start, stop); ``keys`` and ``places`` go together.
    """
    names = [f.split()[0] for f in _TEXTS.split(", ")]
    for whole in batches:
        for batch in spans(whole, "text", BLOCK_BYTES):
            hashes, edges = hashed_words([t or b"" for t in binary(batch, "text")])
            grams = shingles(hashes, width).astype(_GRAM)
            held = batch.column("held")
            of, items = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy()), held.flatten()
            firsts, lists = items.field("first_row").to_numpy(), items.field("places")
            # One after the other, the groups of all texts; no place reaches into the next group.
            order = np.lexsort((firsts, of))
            new = np.ones(len(order), bool)
            new[1:] = (of[order[1:]] != of[order[:-1]]) | (firsts[order[1:]] != firsts[order[:-1]])
            group, some = np.empty(len(order), np.int64), order[new]
            group[order] = np.cumsum(new) - 1
            many = pc.list_value_length(lists).to_numpy() // 2
            keys, group, places = np.repeat(items.field("key").to_numpy(), many), np.repeat(group, many), lists.flatten().to_numpy().reshape(-1, 2)
            order = np.lexsort((places[:, 0], group))
            keys, group, places = keys[order], group[order], places[order]
            apart = group * (edges[-1] + 1)
            first, last = _united(places + apart[:, None])
            parts, texts = np.stack([places[first, 0], places[last, 1]], axis=1), of[some]
            since = edges[texts[group[first]]]
            own = grams[_ranges(parts[:, 0] + since, parts[:, 1] + since)]
            sizes = np.bincount(group[first], parts[:, 1] - parts[:, 0], len(some))
            held_at, parts_at = (np.bincount(x, minlength=len(some)) for x in (group, group[first]))
            columns = [_binaries(x, n) for x, n in ((keys, held_at), (places, held_at), (parts, parts_at), (own, sizes))]
            out = []
            rows, blocks = batch.column("row").to_numpy(), items.field("blocks").to_numpy()[some]
            for k, (row, first_row, n) in enumerate(zip(rows[texts].tolist(), firsts[some].tolist(), blocks.tolist())):
                # Every two blocks of a group meet, each with its first text, so all its pairs are decided and no group is one task.
                mine = row % n
                out += [(k, i, j) for i in range(n) for j in range(i, n)] if row == first_row else [(k, min(mine, m), max(mine, m)) for m in range(n)]
            id_ = batch.column("id").take(pa.array(texts))
            columns = [pa.array(firsts[some]), pc.fill_null(id_, (1 << 63) - 1), pa.array(rows[texts]), id_, *columns]
            for k in range(0, len(out), 1000):
                at, i, j = zip(*out[k : k + 1000])
                first_row, *rest = (c.take(pa.array(at)) for c in columns)
                yield pa.RecordBatch.from_arrays([first_row, pa.array(i, pa.int32()), pa.array(j, pa.int32()), *rest], names)


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of so many values, or rows of values, at a time."""
    step = values.itemsize * values[:1].size if len(values) else 0
    ends = np.concatenate([[0], np.cumsum(sizes)]) * step
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _united(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (start, stop) in order of start, for each that overlapping ones make up, which is its first and which reaches its end."""
    until = np.maximum.accumulate(places[:, 1])
    first = np.flatnonzero(np.concatenate([[True], places[1:, 0] > until[:-1]]))
    ends = np.append(first[1:], len(places)) - 1
    return first, np.searchsorted(until, until[ends])


class _Text:
    """What a text has in a group: shingles of several parts, and the places in the text under each key."""

    def __init__(self, order: int, row: int, id_: int | None, keys: np.ndarray, places: np.ndarray, parts: np.ndarray, grams: np.ndarray, least: int):
        self.order, self.row, self.id, self.keys, self.places, self.grams, self.least = order, row, id_, keys, places, grams, least
        self.edges, self.since = np.concatenate([[0], np.cumsum(parts[:, 1] - parts[:, 0])]), parts[:, 0]
        # Where the places are in ``grams``.
        self.at = places - (self.since - self.edges[:-1])[np.searchsorted(self.since, places[:, 0], side="right") - 1][:, None]
        self.all, self.within = _different(grams), _parts(self.edges, least)
        self.distinct = _distinct(grams, least, len(self.all))

    def only(self, some: np.ndarray) -> _Text:
        """With some of its places, which are in order of start, and no other shingles."""
        if some.all():
            return self
        places, at = self.places[some], self.at[some]
        first, last = _united(places)
        grams = np.concatenate([self.grams[a:b] for a, b in zip(at[first, 0].tolist(), at[last, 1].tolist())])
        return _Text(self.order, self.row, self.id, self.keys[some], places, np.stack([places[first, 0], places[last, 1]], axis=1), grams, self.least)

    def like(self, other: _Text) -> np.ndarray:
        """Starts in ``grams`` of what is similar to a stretch of the other one."""
        sides = ((t.grams, t.edges, t.distinct, t.all, t.within) for t in (self, other))
        return alike_parts(*sides, self.least)

    def holding(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, from which of the starts to which lie in it."""
        return np.searchsorted(starts, self.at[:, 0]), np.searchsorted(starts, self.at[:, 1] - self.least, side="right")

    def stretches(self, starts: np.ndarray) -> list[dict]:
        starts = starts + (self.since - self.edges[:-1])[np.searchsorted(self.edges, starts, side="right") - 1]
        last = np.flatnonzero(starts[1:] > starts[:-1] + self.least).tolist()
        starts = starts.tolist()
        return [{"start": starts[a], "stop": starts[b] + self.least} for a, b in zip([0, *(k + 1 for k in last)], [*last, len(starts) - 1])]

    def who(self) -> dict:
        return {"order": self.order, "row": self.row, "id": self.id}


def _group(texts: list[_Text], first_row: int, mine: bool, least: int) -> Iterator[tuple]:
    """Rows of _FINDS: stretches of texts that are similar to one of an earlier text under one of their keys.

    Texts come in order. Nearly all is decided between a text and the first one, which has all keys of the group: what is similar
    there is credited to it, by the task that has the text as its own (``mine``). Places in which nothing is are
    looked for in the other earlier texts in turn that have their key, until one has something similar.
    """
    first = next((t for t in texts if t.row == first_row), None)
    texts = [t for t in texts if t.row != first_row]
    open_ = []
    for t in texts:
        open_.append(np.ones(len(t.keys), bool))
        if first is not None:
            starts = t.like(first)
            low, high = t.holding(starts)
            open_[-1] = low >= high
            if mine and len(starts):
                yield None, None, t.row, t.id, first.who(), t.stretches(starts)
    if len(texts) < 2:
        return
    rest = [t.only(x) if x.any() else None for t, x in zip(texts, open_)]
    if all(t is None for t in rest[1:]):
        return
    keys = [_different(t.keys) for t in texts]
    for t, others in zip(rest, _sharing(texts, rest, least)):
        left = np.ones(len(t.keys) if t else 0, bool)
        for d, likely in others:
            both = np.flatnonzero(left & likely)
            there = np.searchsorted(keys[d], t.keys[both])
            there[there == len(keys[d])] = 0
            both = both[keys[d][there] == t.keys[both]]
            if not len(both):
                continue
            starts = t.like(texts[d])
            low, high = t.holding(starts)
            found = both[high[both] > low[both]]
            for k in found.tolist():
                yield int(t.keys[k]), int(t.places[k, 0]), t.row, t.id, texts[d].who(), t.stretches(starts[low[k] : high[k]])
            left[found] = False
            if not left.any():
                break


def _sharing(texts: list[_Text], rest: list[_Text | None], least: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """For each of ``rest`` in turn the texts before it that have enough shingles of one of its stretches for a similar one, and the places that hold such stretches.

    All earlier texts are counted at once, so one that has little in common costs some additions, not a comparison.
    """
    values, ranks = np.unique(np.concatenate([t.all for t in texts]), return_inverse=True)
    posted = np.repeat(np.arange(len(texts)), [len(t.all) for t in texts])[np.argsort(ranks, kind="stable")]
    since = np.concatenate([[0], np.cumsum(np.bincount(ranks, minlength=len(values)))])
    floor = np.array([int(t.distinct.min()) for t in texts])
    for p, t in enumerate(rest):
        if t is None or not p:
            yield []
            continue
        own, near = np.searchsorted(values, t.all), []
        first, stop = since[own], since[own + 1]
        few, counts = max(1, POSTED // len(texts)), np.zeros(p, np.int64)
        for v in range(0, len(own), few):
            counts += np.bincount(posted[_ranges(first[v : v + few], stop[v : v + few])], minlength=p)[:p]
        # Similar stretches of so many different shingles share this many.
        some = np.flatnonzero((WHOLE + PART) * counts >= PART * (int(t.distinct.min()) + floor[:p]))
        if len(some):
            at = np.searchsorted(t.all, t.grams)
            has = np.zeros((len(own), min(len(some), step := max(1, POSTED // max(len(t.grams), len(t.keys))))), bool)
            slot = np.full(len(texts), -1)
            for k in range(0, len(some), step):
                block = some[k : k + step]
                slot[block] = np.arange(len(block))
                has[:] = False
                for v in range(0, len(own), few):
                    low, high = first[v : v + few], stop[v : v + few]
                    x, of = slot[posted[_ranges(low, high)]], np.repeat(np.arange(v, v + len(low)), high - low)
                    has[of[x >= 0], x[x >= 0]] = True
                slot[block] = -1
                held = np.cumsum(has[at, : len(block)], axis=0, dtype=np.int32)
                held = np.concatenate([np.zeros((1, len(block)), np.int32), held])
                enough = (WHOLE + PART) * (held[least:] - held[:-least]) >= PART * (t.distinct[:, None] + floor[block])
                held = np.zeros((len(enough) + 1, len(block)), np.int32)
                np.cumsum(enough & t.within[:, None], axis=0, out=held[1:])
                likely = held[t.at[:, 1] - least + 1] > held[t.at[:, 0]]
                near += [(int(block[x]), likely[:, x]) for x in np.flatnonzero(likely.any(axis=0)).tolist()]
        yield near


def _near(docs: DataFrame, scratch: Scratch, found: DataFrame, copies: DataFrame, least: int, width: int) -> DataFrame:
    """(row, id, first_id, start, stop) of the stretches that are similar to one of an earlier document under their key.

    Texts are grouped by the first text that has one of their keys. A text goes to each of its groups once, with the
    shingles of all that it has there, however many keys that are.
    """
    # A copy of a whole text has what its first document has, which alone is searched.
    found = found.join(copies.select("row"), "row", "left_anti")
    several = found.groupBy("key").agg(F.min(F.struct(_order(), "row")).alias("first"), F.max("row").alias("high"), F.min("row").alias("low"))
    held = found.join(several.filter("low <> high").select("key", F.col("first.row").alias("first_row")), "key")
    length = F.aggregate("places", F.lit(0), lambda n, x: x - n)  # the stops less the starts, as there is an even number
    held = scratch.keep(held.select("first_row", "row", "id", "key", "places", length.alias("length")), "near-members")
    sizes = held.groupBy("first_row").agg(F.count_distinct("row").alias("n"), F.sum("length").alias("length"))
    sizes = sizes.select("first_row", F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("length") / GRAMS)).cast("int").alias("blocks")).filter("blocks > 1")
    sizes = scratch.keep(sizes, "near-sizes")
    held = held.join(F.broadcast(sizes), "first_row", "left")
    held = held.groupBy("row").agg(F.first("id").alias("id"), F.collect_set(F.struct("key", "first_row", F.coalesce("blocks", F.lit(1)).alias("blocks"), "places")).alias("held"))
    held = scratch.keep(held, "near-held")
    scratch.drop("near-members", "near-sizes")
    # A bitmap of fixed size lets most texts that are not asked for stay.
    bits = bitmap(held.select(place("row").alias("at")))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(marked(bits, batch.column("at"))).select(["row", "text"])

    texts = docs.select("row", "text", place("row").alias("at")).mapInArrow(likely, "row long, text string").dropDuplicates(["row"])
    texts = texts.join(held, "row").select("row", "id", "text", "held")
    texts = scratch.keep(texts.mapInArrow(lambda batches: _texts(batches, least, width), _TEXTS), "near-texts")
    scratch.drop("near-held")
    dealt = texts.repartition("first_row", "i", "j").sortWithinPartitions("first_row", "i", "j", "order", "row")
    names = [f.split()[0] for f in _FINDS.split(", ")[:4]] + ["better", "spans"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (f.split()[0] for f in _TEXTS.split(", "))]
            for first, i, j, *rest in zip(*columns):
                if (first, i, j) != now:
                    out += matched(now, own)
                    now, own = (first, i, j), []
                order, row, id_, keys, places, parts, grams = rest
                places, parts = (np.frombuffer(x, np.int32).reshape(-1, 2) for x in (places, parts))
                own.append(_Text(order, row, id_, np.frombuffer(keys, np.int64), places, parts, np.frombuffer(grams, _GRAM), least))
            yield from rows_of(out)
        yield from rows_of(matched(now, own))

    def matched(at: tuple | None, own: list[_Text]) -> list[tuple]:
        return list(_group(own, at[0], at[1] == at[2], least)) if len(own) > 1 else []

    def rows_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FIND_TYPES)], names)

    finds = scratch.keep(dealt.mapInArrow(compare, _FINDS), "near-finds")
    scratch.drop("near-texts")
    # Of what the blocks of a group have found, the first document.
    other = finds.filter("key IS NOT NULL").groupBy("key", "place", "row").agg(F.min(F.struct("better", "spans", "id")).alias("found"))
    credited = finds.filter("key IS NULL").select("row", "id", F.col("better.id").alias("first_id"), "spans")
    credited = credited.unionAll(other.select("row", "found.id", F.col("found.better.id").alias("first_id"), "found.spans"))
    return credited.select("row", "id", "first_id", F.explode("spans").alias("span")).select("row", "id", "first_id", "span.start", "span.stop").distinct()


def _merged(found: DataFrame) -> DataFrame:
    """(row, id, first_id, start, stop): overlapping stretches of one document and first document put together."""
    # A stretch touches those before it where its start is not past the largest end so far.
    spans_ = F.array_sort(F.collect_set(F.struct("start", "stop")))
    joined = F.aggregate(
        spans_,
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] <= F.element_at(done, -1)["stop"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))),
    )
    return found.groupBy("row", "id", "first_id").agg(joined.alias("spans"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    row = F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _found(source: DataFrame, scratch: Scratch, passage: int, width: int, block_bytes: int) -> DataFrame:
    least = passage - width + 1
    size = source.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    # A text of w words has about 2w / least windows for each function, and a run for each STEP of each of them.
    keys = size // 5 * 2 // least * (FUNCTIONS + least // STEP)
    blocks = source.mapInArrow(lambda batches: block_rows(_payloads(batches, least, width, block_bytes)), BLOCK_DDL)
    blocks = scratch.keep(blocks, "windows")
    totals = scratch.keep(totals_of(blocks, _counts, bucket_bits(keys)), "window-counts")
    found = scratch.keep(answered(blocks, totals).mapInArrow(lambda batches: _shared(batches, least), _FOUND), "shared")
    scratch.drop("windows", "window-counts")
    exact = scratch.keep(_credited(found.filter("kind = 0")).drop("kind", "key", "payload"), "exact")
    covered = scratch.keep(exact.groupBy("block").applyInArrow(lambda group: _covered(group, least - STEP), _COVERED), "covered")
    scratch.drop("exact")
    pieces = covered.filter("covered IS NOT NULL").select("block", "covered")
    open_ = found.filter("kind = 1").select("block", "payload").join(pieces, "block", "left").select("payload", "covered")
    stretches = scratch.keep(open_.mapInArrow(lambda batches: _stretches(batches, least), "key long, row long, id long, places array<int>"), "stretches")
    scratch.drop("shared")
    exact = covered.filter("covered IS NULL").select("row", "id", "first_id", "start", "stop")
    copies = scratch.keep(_copies(source), "copies")
    near = scratch.keep(_near(source, scratch, stretches, copies, least, width), "near")
    same = near.select(F.col("row").alias("first_row"), "first_id", "start", "stop").join(copies, "first_row")
    near = near.unionByName(same.select("row", "id", "first_id", "start", "stop"))
    merged = scratch.keep(_merged(exact.unionByName(near)), "repeats")
    scratch.drop("covered", "stretches", "near-finds", "copies", "near")
    return merged


def repeats(
    docs: DataFrame,
    scratch: Scratch,
    passage: int = PASSAGE,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, first_id, start, stop): each stretch of words that stands in an earlier document as well.

    Words are counted from 0 and ``stop`` is past the last. ``first_id`` is the smallest id
    of those that have it. Texts of fewer words than ``passage`` less ``STEP``, null and
    empty ones have none. Equal rows, id and text, are one document, which does not
    repeat itself; nor does a passage within one document. A null id comes after all
    others. An empty table gives an empty result. Other columns are ignored, whatever
    their names.
    """
    found = _found(_source(docs, id_col, text_col), scratch, passage, width, block_bytes)
    span = found.select("id", "first_id", F.explode("spans").alias("span"))
    span = span.select(F.col("id").alias(id_col), "first_id", F.col("span.start").alias("start"), (F.col("span.stop") + width - 1).alias("stop"))
    return span.distinct()


def without_repeats(
    docs: DataFrame,
    scratch: Scratch,
    passage: int = PASSAGE,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs``, with the stretches of ``repeats`` cut out of the text.

    A cut takes the white space after it along. Rows without repeats are as they were; a
    document of which nothing is left has an empty text.
    """
    source = _source(docs, id_col, text_col)
    found = _found(source, scratch, passage, width, block_bytes)
    row, places = fresh(docs, "row"), fresh(docs, "places")
    places_of = found.groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("spans")).alias(places))
    frame = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    frame = frame.join(places_of, row, "left")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([_without(t, s, width) if s else t for t, s in zip(texts.to_pylist(), lists.to_pylist())], pa.string())

    new = F.when(F.col(places).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(places)))
    return frame.withColumn(text_col, new).select(*docs.columns)


def _without(text: str, spans_: list[dict], width: int) -> str:
    data = text.encode()
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for s in sorted(spans_, key=lambda s: (s["start"], s["stop"])):
        start, stop = starts[s["start"]], starts[min(s["stop"] + width - 1, len(starts) - 1)]
        if start > at:
            out.append(data[at:start])
        at = max(at, stop)
    return b"".join([*out, data[at:]]).decode()
