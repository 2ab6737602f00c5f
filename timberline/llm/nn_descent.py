"""Embedding near-dedup by NN-descent.

A neighbour graph starts from vectors that stand next to each other in a few orders
of random hyperplane signatures. In each round the neighbours of a vector, forward
and reverse, meet at it and are compared with each other, and every vector keeps
its nearest ones, until the lists settle. Searching compares vectors in 8 bits for
each component; every link is then tested in double precision.

Lists that are saturated, because all that they hold is over the threshold, are
enlarged to their whole connected component: it is compared in blocks, of which
only the counts leave a task. An audit compares a bounded sample of vectors with
all rows, and if too many of their links are missing, the lists grow and the
descent goes on. Where the longest lists fail as well, all vectors are compared in
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timberline.llm.common import Scratch, components, groups, numbered

NEIGHBOURS, MOST_NEIGHBOURS = 8, 64
ORDERS, WIDTH = 6, 3
ROUNDS = 6
BLOCK = 512
AUDITED = 1024
RECALL = 0.995
_SLACK = 0.03  # more than 8 bits for each component change a cosine


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _units(vectors: DataFrame, width: int) -> DataFrame:
    """(id, unit): the vector at length 1 as doubles, NULL if it links with nothing."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("vec").to_pylist():
                if value is None or None in value:
                    out.append(None)
                    continue
                v = np.zeros(width)
                v[: len(value)] = value
                largest = np.abs(v).max(initial=0.0)
                if not 0 < largest < np.inf:  # also false for NaN
                    out.append(None)
                    continue
                v /= largest
                out.append((v / np.sqrt(v @ v)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "unit"])

    return vectors.mapInArrow(scale, f"id {dict(vectors.dtypes)['id']}, unit binary")


def _small(units: np.ndarray) -> np.ndarray:
    scale = np.abs(units).max(axis=1, keepdims=True)
    return np.rint(units / scale * 127).astype(np.int8)


def _cosines(a: np.ndarray) -> np.ndarray:
    """Each row at length 1, as 32-bit floats."""
    a = a.astype(np.float32)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _first_pairs(nodes: DataFrame, width: int, orders: int, near: int) -> DataFrame:
    """(a, b, cos) of vectors that stand near each other in an order."""
    planes = np.random.default_rng(7).standard_normal((orders, 64, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _matrix(batch.column("unit"), np.float64)
            small = pa.array([r.tobytes() for r in _small(units)], pa.binary())
            for k in range(orders):
                marks = np.packbits(units @ planes[k].T > 0, axis=1)
                columns = [pa.array([k] * len(units), pa.int32()), pa.array([m.tobytes() for m in marks], pa.binary()), batch.column("node"), small]
                yield pa.RecordBatch.from_arrays(columns, ["turn", "mark", "node", "small"])

    signed = nodes.select("node", "unit").mapInArrow(sign, "turn int, mark binary, node long, small binary")
    # Range partitions cut the order in a few places, where a first pair is missed.
    lined = signed.repartitionByRange("turn", "mark", "node").sortWithinPartitions("turn", "mark", "node")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            turn, node = batch.column("turn").to_numpy(), batch.column("node").to_numpy()
            rows = _cosines(_matrix(batch.column("small"), np.int8))
            if before is not None:
                turn, node, rows = (np.concatenate(x) for x in zip(before, (turn, node, rows)))
            old = 0 if before is None else len(before[0])
            for d in range(1, near + 1):
                second = np.arange(max(d, old), len(node))
                second = second[turn[second] == turn[second - d]]
                cos = (rows[second] * rows[second - d]).sum(axis=1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(node[second - d]), pa.array(node[second]), pa.array(cos)], ["a", "b", "cos"])
            before = turn[-near:], node[-near:], rows[-near:]

    return lined.mapInArrow(pair, "a long, b long, cos double")


def _nearest(pairs: DataFrame, size: int) -> DataFrame:
    """(u, v, cos, place): the nearest of each vector among the pairs (a, b, cos), both ways."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "cos").unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "cos"))
    once = both.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    place = F.row_number().over(W.partitionBy("u").orderBy(F.desc("cos"), "v"))
    return once.withColumn("place", place).filter(F.col("place") <= size)


def _met(graph: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(a, b, cos) of neighbours of one vector that belong into each other's lists."""
    # Reverse lists are as long as forward ones; a vector that many lists hold is cut down in 32 parts first.
    part = F.pmod(F.xxhash64("u"), F.lit(32))
    back = graph.withColumn("_place", F.row_number().over(W.partitionBy("v", part).orderBy(F.desc("cos"), "u"))).filter(F.col("_place") <= size)
    back = back.withColumn("_place", F.row_number().over(W.partitionBy("v").orderBy(F.desc("cos"), "u"))).filter(F.col("_place") <= size)
    lists = graph.select(F.col("u").alias("at"), F.col("v").alias("node")).unionAll(back.select(F.col("v").alias("at"), F.col("u").alias("node")))
    lists = lists.distinct()
    last = graph.filter(F.col("place") == size).select(F.col("u").alias("node"), F.col("cos").alias("last"))
    known = nodes.select("node", "small").join(last, "node", "left").fillna(-2.0, ["last"])
    meeting = lists.join(known, "node").repartition("at").sortWithinPartitions("at", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["at"]):
            node, last = table.column("node").to_numpy(), table.column("last").to_numpy()
            own = _cosines(_matrix(table.column("small").combine_chunks(), np.int8))
            cos = own @ own.T
            i, j = np.nonzero(np.triu(cos > np.minimum(last[:, None], last[None, :]), 1))
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(cos[i, j].astype(np.float64))], ["a", "b", "cos"])

    return meeting.select("at", "node", "small", "last").mapInArrow(compare, "a long, b long, cos double")


def descend(nodes: DataFrame, scratch: Scratch, width: int, size: int, start: DataFrame | None, rounds: int, tag: str) -> DataFrame:
    """The graph (u, v, cos, place) after rounds of neighbours' neighbours, from ``start`` or from first pairs."""
    pairs = _first_pairs(nodes, width, ORDERS, WIDTH) if start is None else start.select(F.col("u").alias("a"), F.col("v").alias("b"), "cos")
    graph = scratch.keep(_nearest(pairs, size), f"graph-{tag}-0")
    for k in range(1, rounds + 1):
        pairs = graph.select(F.col("u").alias("a"), F.col("v").alias("b"), "cos").unionAll(_met(graph, nodes, size))
        after = scratch.keep(_nearest(pairs, size), f"graph-{tag}-{k}")
        total = after.count()
        new = after.join(graph.select("u", "v"), ["u", "v"], "left_anti").count()
        scratch.drop(f"graph-{tag}-{k - 1}")
        graph = after
        if new <= 0.005 * total:
            break
    return graph


def _exact(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the graph whose cosine in double precision reaches the threshold."""
    likely = graph.filter(F.col("cos") >= threshold - _SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("unit").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("unit").alias("y"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_matrix(batch.column(c), np.float64) for c in "xy")
                yield batch.select(["a", "b"]).filter(pa.array((x * y).sum(axis=1) >= threshold))

    return likely.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def _counts(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(node, others, links): rows and nodes linked with each node of a component, counted block by block."""
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = roots.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.join(nodes.select("node", "unit", "rows"), "node")
    dealt = dealt.withColumn("key", F.struct("root", "i", "j")).repartition("key").sortWithinPartitions("root", "i", "j", "block", "node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["root", "i", "j"]):
            units, rows, block, node = (
                _matrix(table.column("unit").combine_chunks(), np.float64), *(table.column(c).to_numpy() for c in ("rows", "block", "node"))
            )
            first = block == table.column("i")[0].as_py()
            if table.column("i")[0].as_py() == table.column("j")[0].as_py():
                linked = units @ units.T >= threshold
                np.fill_diagonal(linked, False)
                others, links = linked @ rows, linked.sum(axis=1)
            else:
                linked = units[first] @ units[~first].T >= threshold
                others, links = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
                others[first], others[~first] = linked @ rows[~first], linked.T @ rows[first]
                links[first], links[~first] = linked.sum(axis=1), linked.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(node), *(pa.array(x.astype(np.int64)) for x in (others, links))], ["node", "others", "links"])

    parts = dealt.select("root", "i", "j", "block", "node", "unit", "rows").mapInArrow(count, "node long, others long, links long")
    return parts.groupBy("node").agg(F.sum("others").alias("others"), F.sum("links").alias("links"))


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) that connect all vectors linked with each other, from comparing every two blocks of them."""
    blocks = -(-nodes.count() // BLOCK)
    own = nodes.select("node", "unit").withColumn("block", (F.col("node") % F.lit(max(1, blocks))).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))))
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "unit")
    dealt = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["i", "j"]):
            units, node = _matrix(table.column("unit").combine_chunks(), np.float64), table.column("node").to_numpy()
            linked = units @ units.T >= threshold
            # Of a component only a link from its first vector to each other one leaves the task.
            left, a, b = np.ones(len(node), bool), [], []
            for first in range(len(node)):
                if not left[first]:
                    continue
                left[first] = False
                front = np.array([first])
                while len(front):
                    front = np.flatnonzero(linked[front].any(axis=0) & left)
                    left[front] = False
                    a += [node[first]] * len(front)
                    b += node[front].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _recall(nodes: DataFrame, roots: DataFrame, counted: DataFrame, threshold: float, audited: int) -> float:
    """The mean share of the links of a vector that were counted, over those of a sample that have links.

    Half of the sample, at most ``audited`` vectors in all, is drawn from all of them and half from
    those outside components of over BLOCK vectors; the smaller of the two shares holds.
    """
    large = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("root")
    small = nodes.join(roots.join(large, "root").select("node"), "node", "left_anti")
    parts = []
    for salt, part in ((3, nodes), (4, small)):
        drawn = part.orderBy(F.xxhash64("node", F.lit(salt)), "node").limit(max(1, audited // 2)).join(counted, "node", "left")
        parts.append(drawn.select("node", "unit", F.coalesce("links", F.lit(0)).alias("links")).collect())
    sample = [r for part in parts for r in part]
    if not sample:
        return 1.0
    queries = np.frombuffer(b"".join(bytes(r.unit) for r in sample)).reshape(len(sample), -1)
    own = np.array([r.node for r in sample])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                linked = queries @ _matrix(batch.column("unit"), np.float64).T >= threshold
                linked &= own[:, None] != batch.column("node").to_numpy()[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(linked.sum(axis=1))], ["k", "n"])

    truth = np.zeros(len(own))
    for r in nodes.select("node", "unit").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        truth[r.k] = r.n
    shares = np.minimum(1, np.array([r.links for r in sample]) / np.maximum(1, truth))
    halves = np.arange(len(own)) < len(parts[0])
    return min([float(shares[half & (truth > 0)].mean()) for half in (halves, ~halves) if (half & (truth > 0)).any()], default=1.0)


def near_duplicates(
    vectors: DataFrame, scratch: Scratch, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", audited: int = AUDITED
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    n_links counts other rows at a cosine of at least ``threshold``, component_id is
    the smallest id reachable by links, itself included, and kept is id = component_id.
    A vector that is null, empty or zero, or that holds a null or non-finite component,
    links with nothing. Equal directions are one node of the search and link with each
    other. Shorter vectors count as filled up with zeros. Of rows with one id, each
    counts as a row; a null id stays null and is kept if nothing links with it. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    width = source.agg(F.max(F.size("vec"))).first()[0] or 0
    rows = scratch.keep(_units(source, max(1, width)).withColumn("mark", F.unhex(F.md5("unit"))), "units")
    same = rows.filter("mark IS NOT NULL").groupBy("mark").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("rows"), F.min("id").alias("least"))
    many = rows.count()

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                small = _small(_matrix(batch.column("unit"), np.float64))
                yield batch.append_column("small", pa.array([r.tobytes() for r in small], pa.binary()))

    nodes = numbered(same, [], [F.col("mark")], many, "node")
    nodes = scratch.keep(nodes.mapInArrow(shrink, "mark binary, unit binary, rows long, least long, node long, small binary"), "nodes")
    size, graph = NEIGHBOURS, None
    while True:
        if size <= MOST_NEIGHBOURS:
            graph = descend(nodes, scratch, max(1, width), size, graph, ROUNDS, str(size))
            links = _exact(graph, nodes, threshold)
        else:
            links = _all_links(nodes, threshold)
        links = scratch.keep(links, f"links-of-{size}")
        roots = scratch.keep(components(links, scratch), f"roots-{size}")
        counted = scratch.keep(_counts(nodes, roots, threshold), f"counted-{size}")
        if size > MOST_NEIGHBOURS or _recall(nodes, roots, counted, threshold, audited) >= RECALL:
            break
        size *= 2
    found = nodes.select("node", "mark", "rows", "least").join(roots, "node", "left").join(counted.drop("links"), "node", "left")
    # A node without links is a component of its own, so that no key stands for all of them.
    found = found.withColumn("root", F.coalesce("root", "node"))
    found = found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    found = found.select(
        "mark", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("id", "mark").join(found, "mark", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
