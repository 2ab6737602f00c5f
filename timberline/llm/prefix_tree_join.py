"""N-gram Jaccard join over prefix trees.

Each document is the set of its word n-grams, hashed to 64 bits and ordered by hash,
which is one global order. Equal sets are joined once. Two sets that reach the
threshold share n-grams early in the order, so:

1. A set keeps its first 64 n-grams. A set of which too few occur in any other set
   can have no partner and is done; for the rest whole sets are made.
2. Sets meet at their first n-grams (the prefix of length n - ceil(t * n) + 1, cut at
   the length from which a pair that reaches t misses with a chance under 1e-16).
3. Sets that meet at one n-gram are stored in a prefix tree, most frequent n-grams
   first, so that what they share is stored and compared once. For each set the tree
   is walked level by level with the overlap so far; a subtree is left as soon as its
   longest remaining path can't bring the overlap to what its smallest set needs.

First sets meet at their first n-gram only, and what links becomes one component.
Then those n-grams at which several components meet are gone through. Many sets at
one n-gram are dealt into blocks, and each pair of blocks is a tree of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
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
    components,
    groups,
    marked,
    numbered,
    pack,
    place,
    shingles,
    totals_of,
    unpack,
    word_hashes,
    words,
)

KEPT = 64
BLOCK_GRAMS = 400_000
BLOCK_SETS = 4096
_RARE = 1e-16


def gram_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text; of its whole sequence if it has fewer words."""
    return np.unique(shingles(word_hashes(words(text)), width))


def meeting_length(part: int, whole: int) -> int:
    """So many first n-grams of a union that all miss the intersection with a chance under 1e-16."""
    return math.ceil(math.log(_RARE) / math.log(1 - part / whole)) if part < whole else 1


def least_shared(size: int, part: int, whole: int) -> int:
    """How many of a set's kept n-grams occur in a set that it links with (for sets over KEPT: with a chance under 1e-16 of fewer)."""
    if size <= KEPT:
        beyond = max(0, size * whole // part - KEPT)  # n-grams that the partner may not have kept
        return max(1, -(-part * size // whole) - beyond)
    miss, tail = 1 - part / whole, 0.0
    for missed in range(KEPT, 0, -1):
        tail += math.comb(KEPT, missed) * miss**missed * (1 - miss) ** (KEPT - missed)
        if tail > _RARE:
            return max(1, KEPT - missed)
    return KEPT


class Tree:
    """A prefix tree of sets of ranks, kept level by level; paths without a branch are one node."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        common = [0]
        for a, b in zip(order, order[1:]):
            n = min(len(sets[a]), len(sets[b]))
            differ = np.flatnonzero(sets[a][:n] != sets[b][:n])
            common.append(int(differ[0]) if len(differ) else n)
        common.append(0)
        self.levels = []
        now = [(0, len(order), 0, 0)]  # sets from, to, depth, node above
        while now:
            paths, above, longest, smallest, ending, after = [], [], [], [], [], []
            for start, end, depth, parent in now:
                k = start
                while k < end:
                    last = k + 1
                    while last < end and common[last] > depth:
                        last += 1
                    held = order[k:last]
                    stop = min(common[k + 1 : last], default=len(sets[held[0]]))
                    paths.append(sets[held[0]][depth:stop])
                    above.append(parent)
                    longest.append(max(len(sets[h]) for h in held) - stop)
                    smallest.append(min(sizes[h] for h in held))
                    done = [h for h in held if len(sets[h]) == stop]
                    ending += [(len(paths) - 1, h) for h in done]
                    if len(done) < len(held):
                        after.append((k + len(done), last, stop, len(paths) - 1))
                    k = last
            lengths = np.array([len(p) for p in paths])
            starts = np.cumsum(lengths) - lengths
            ends = np.array(ending, np.int64).reshape(-1, 2)
            self.levels.append((np.concatenate(paths), starts, lengths, np.array(above), np.array(longest), np.array(smallest), ends))
            now = after

    def walk(self, own: np.ndarray, size: int, held: np.ndarray, part: int, whole: int) -> Iterator[tuple[int, int]]:
        """(set, overlap) of the sets that reach the threshold with ``own``; ``held`` marks its ranks."""
        overlap = np.zeros(1, np.int64)
        for paths, starts, lengths, above, longest, smallest, ends in self.levels:
            live = np.flatnonzero(overlap[above] >= 0)
            if not len(live):
                return
            n = lengths[live]
            shift = np.cumsum(n) - n
            at = np.repeat(starts[live] - shift, n) + np.arange(n.sum())
            hits = np.concatenate([[0], np.cumsum(held[paths[at]])])
            sofar = overlap[above[live]] + hits[shift + n] - hits[shift]
            needed = -(-part * (size + smallest[live]) // (whole + part))
            can = sofar + np.minimum(len(own) - sofar, longest[live]) >= needed
            overlap = np.full(len(starts), -1)
            overlap[live[can]] = sofar[can]
            for node, other in ends[overlap[ends[:, 0]] >= 0]:
                both = int(overlap[node])
                if whole * both >= part * (size + int(self.sizes[other]) - both):
                    yield int(other), both


def links(sets: list[np.ndarray], roots: list[int], sides: list[int], part: int, whole: int) -> list[tuple[int, int]]:
    """Pairs of positions that link sets of different roots, as many as join what can be joined.

    ``sides`` tells the two blocks of a pair of blocks apart, within which nothing is left to find.
    """
    sizes = np.array([len(s) for s in sets])
    alive = np.arange(len(sets))
    root = {r: r for r in roots}

    def find(r: int) -> int:
        while root[r] != r:
            root[r] = root[root[r]]
            r = root[r]
        return r

    joined = np.concatenate(sets)
    grams, at = np.unique(joined, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    allowed = sizes - -(-part * sizes // whole)
    while True:
        # A set with too many n-grams of its own has no partner here.
        found = np.bincount(at, minlength=len(grams))
        single = np.bincount(owner[found[at] == 1], minlength=len(sets))
        rest = alive[single[alive] <= allowed[alive]]
        if len(rest) < 2 or len({roots[k] for k in rest}) < 2 or len({sides[k] for k in rest}) < len(set(sides)):
            return []
        if len(rest) == len(alive):
            break
        alive = rest
        keep = np.isin(owner, alive)
        at, owner = at[keep], owner[keep]
    order = np.argsort(-found, kind="stable")
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    shared = found[at] > 1
    at, owner = rank[at[shared]], owner[shared]
    by_owner = np.lexsort((at, owner))
    at, owner = at[by_owner], owner[by_owner]
    edges = np.searchsorted(owner, [alive, alive + 1])
    ranks = [at[a:b] for a, b in edges.T]
    tree = Tree(ranks, sizes[alive])
    held, out, two = np.zeros(len(grams), bool), [], len(set(sides)) > 1
    for k, own in zip(alive.tolist(), ranks):
        held[own] = True
        for other, _ in tree.walk(own, int(sizes[k]), held, part, whole):
            other = int(alive[other])
            if other != k and not (two and sides[k] == sides[other]):
                a, b = find(roots[k]), find(roots[other])
                if a != b:
                    root[a] = b
                    out.append((k, other))
        held[own] = False
    return out


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, mark, first): the size of each document's set, a 128-bit mark of it, and its first n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_set(t, width) for t in binary(batch, "text")]
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            columns = [pa.array([len(s) for s in found], pa.int64()), pa.array(marks, pa.binary()), pa.array([s[:KEPT].tobytes() for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n", "mark", "first"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n long, mark binary, first binary")


def _likely(sets: DataFrame, scratch: Scratch, part: int, whole: int) -> DataFrame:
    """(node, n, meets): the sets that share enough of their first n-grams, and where they can meet others."""

    def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_SETS):
                some = batch.slice(start, BLOCK_SETS)
                firsts = [np.frombuffer(b, np.uint64) for b in some.column("first").to_pylist()]
                yield some.column("node").to_numpy(), some.column("n").to_numpy(), pack(np.concatenate(firsts)), [len(f) for f in firsts]

    def counts(payload: tuple) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(unpack(payload[2]), return_counts=True)

    longest = meeting_length(part, whole)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (nodes, sizes, firsts, lengths), totals in by_block(batches):
            firsts = unpack(firsts)
            keys, at = np.unique(firsts, return_inverse=True)
            shared = totals[at] > 1
            edges = np.concatenate([[0], np.cumsum(lengths)])
            out = []
            for k, n in enumerate(sizes.tolist()):
                own = slice(edges[k], edges[k + 1])
                prefix = slice(edges[k], edges[k] + min(longest, n - -(-part * n // whole) + 1))
                # A set can share enough and yet none of its prefix; then it meets no other.
                if shared[prefix].any() and shared[own].sum() >= least_shared(n, part, whole):
                    out.append((int(nodes[k]), n, firsts[prefix][shared[prefix]].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["node", "n", "meets"])

    blocks = sets.select("node", "n", "first").mapInArrow(lambda batches: block_rows(payloads(batches)), BLOCK_DDL)
    blocks = scratch.keep(blocks, "first-grams")
    totals = scratch.keep(totals_of(blocks, counts, bucket_bits(KEPT * sets.count())), "gram-counts")
    found = scratch.keep(answered(blocks, totals).mapInArrow(pick, "node long, n long, meets array<long>"), "likely")
    scratch.drop("first-grams", "gram-counts")
    return found


def _whole_sets(docs: DataFrame, likely: DataFrame, width: int) -> DataFrame:
    """(node, grams) of the likely sets, made from their texts again.

    Which documents to read is told by a bitmap of fixed size, 2 MB, that travels with
    the tasks; what it lets through wrongly is dropped by the join on the mark.
    """
    bits = bitmap(likely.select(place("least").alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in binary(batch.filter(marked(bits, batch.column("at"))), "text"):
                found = gram_set(text, width)
                mark = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([pa.array([mark], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["mark", "grams"])

    source = docs.select("text", place("id").alias("at"))
    made = source.mapInArrow(run, "mark binary, grams binary").join(likely.select("mark", "node"), "mark")
    return made.groupBy("node").agg(F.first("grams").alias("grams"))


def _meet(grams: DataFrame, routed: DataFrame, part: int, whole: int) -> DataFrame:
    """(a, b): links between sets routed to the same (at, i, j)."""
    dealt = routed.join(grams, "node").repartition("at", "i", "j").sortWithinPartitions("at", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["at", "i", "j"]):
            if table.num_rows < 2:
                continue
            nodes, roots, sides = (table.column(c).to_pylist() for c in ("node", "root", "block"))
            sets = [np.frombuffer(b, np.uint64) for b in table.column("grams").to_pylist()]
            out = links(sets, roots, sides, part, whole)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in side], pa.int64()) for side in zip(*out)], ["a", "b"])

    return dealt.select("at", "i", "j", "node", "root", "block", "grams").mapInArrow(run, "a long, b long")


def join(
    docs: DataFrame, scratch: Scratch, width: int = 3, part: int = 90, whole: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents linked by a Jaccard similarity of at least part / whole.

    Words are runs of other characters than U+0020 and U+0009..U+000D, with A-Z lower-cased.
    A text of fewer words than ``width`` is one n-gram; a null text, or one without
    words, has none and links with nothing. component_id is the smallest id reachable by
    links, itself included. Rows with one id are rows of their own; a null id is never
    the smallest, and stays null where no other is reachable. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = scratch.keep(_sets(source, width), "sets-of-rows")
    own = rows.filter("n > 0").groupBy("mark").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("first").alias("first"))
    sets = scratch.keep(numbered(own, [], [F.col("mark")], rows.count(), "node"), "sets")
    likely = _likely(sets, scratch, part, whole)
    known = likely.join(sets.select("node", "mark", "least"), "node")
    grams = scratch.keep(_whole_sets(source, known, width), "grams")

    meets = likely.withColumn("root", F.col("node"))
    first = meets.select("node", "root", "n", F.col("meets")[0].alias("at"))
    many = first.groupBy("at").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("sets"))
    first = first.join(many.filter("sets > 1"), "at").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    routed = first.select("node", "root", "at", F.col("block").alias("i"), F.col("block").alias("j"), "block")
    found = scratch.keep(_meet(grams, routed, part, whole), "links-1")
    roots = scratch.keep(components(found, scratch), "roots-1")

    rest = likely.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = rest.select("node", "root", "n", F.explode("meets").alias("at"))
    many = rest.groupBy("at").agg(
        F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    rest = rest.join(many.filter("low <> high"), "at").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    routed = rest.select("node", "root", "at", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    more = scratch.keep(_meet(grams, routed, part, whole), "links-2")
    scratch.drop("grams")

    roots = scratch.keep(components(found.unionAll(more), scratch), "roots-2")
    placed = sets.select("node", "mark", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").select("mark", "component_id")
    out = rows.select("id", "n", "mark").join(placed, "mark", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
