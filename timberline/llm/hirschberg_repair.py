"""Repair of conversation structure by Hirschberg's divide and conquer.

A repaired conversation is nothing, or a system row at most and then pairs of a user
and an assistant row. Four states say where one stands: at the start, after the system,
the user, the assistant. An edit keeps a row, gives it another role, deletes it, or
inserts an empty one; the cheapest edits are wanted, and of these the ones whose
initials come first in ASCII order.

Costs up to a row are a vector over the states, and so are costs from a row to the
end. They meet at the middle row, the best crossing state divides the problem in two,
and each half is solved in the same way, so only vectors are held, never a table.
A vector also ranks the edits that lead to its states. Inserts are counted to the row
they precede, so all ways up to a row end in an edit that consumes one: none is the
beginning of another, their order is decided before what follows, and ranks suffice.

Rows are sorted by conversation and turn over the whole table, and cut into blocks of
4,096 rows. A block sums up its part of a conversation as a matrix of costs and ranks,
the crossings between blocks are found on these, and then all blocks are solved apart,
so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch

BLOCK_BITS = 12

# The costs of the edits, and the white space of a blank text.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"

# States: 0 start, 1 system, 2 user, 3 assistant. Where a row of each initial leads from each.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ROLES = {"u": "user", "a": "assistant"}
STATES = range(4)
SOUND, CONDEMNED, CUT = range(3)  # a row that may stay, must go, may stay at a price
INITIALS = "sua-"  # the last is any other

Cell = tuple[int, int]
Table = list[list[tuple[int, int, int]]]  # for each state before: state after, cost, rank of the edits


def _inserted(state: int) -> tuple[str, int]:
    initial = "u" if "u" in NEXT[state] else "a"
    return initial, NEXT[state][initial]


def _units(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """For states before and after a row, the best (cost, initials) of inserts before it and its own edit."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    price = TRUNCATED if fault == CUT else 0
    for before in STATES:
        state = before
        for inserts in range(4):
            ways = [(state, DELETE, "D")]
            if fault != CONDEMNED:
                ways += [(NEXT[state][initial], KEEP + price, "K")] if initial in NEXT[state] else []
                ways += [(NEXT[state][to], REROLE + price, "R") for to in ROLES if to in NEXT[state]]
            for after, cost, edit in ways:
                way = (inserts * INSERT + cost, "I" * inserts + edit)
                best[before, after] = min(best.get((before, after), way), way)
            state = _inserted(state)[1]
    return best


CLASSES = [_units(initial, fault) for initial in INITIALS for fault in (SOUND, CONDEMNED, CUT)]
_ORDER = {unit: k for k, unit in enumerate(sorted({unit for units in CLASSES for _, unit in units.values()}))}
ROW_TABLES: list[Table] = [
    [[(after, cost, _ORDER[unit]) for (b, after), (cost, unit) in sorted(units.items()) if b == before] for before in STATES] for units in CLASSES
]
# What follows the last row: inserts that complete a pair. The ranks are those of "", "I" and "II".
ENDING: list[Cell | None] = [(0, 0), (2 * INSERT, 2), (INSERT, 1), (0, 0)]


def _ranked(cells: list[tuple | None]) -> list[Cell | None]:
    """(cost, key...) to (cost, place of the key among all)."""
    place = {key: k for k, key in enumerate(sorted({c[1:] for c in cells if c}))}
    return [c and (c[0], place[c[1:]]) for c in cells]


def _stepped(vector: list[Cell | None], table: Table) -> list[tuple | None]:
    out: list[tuple | None] = [None] * 4
    for before, cell in enumerate(vector):
        if cell:
            for after, cost, rank in table[before]:
                way = (cell[0] + cost, cell[1], rank)
                if out[after] is None or way < out[after]:
                    out[after] = way
    return out


def forward(vector: list[Cell | None], table: Table) -> list[Cell | None]:
    """Costs and ranks of all ways up to the end of a step, from those up to its start."""
    return _ranked(_stepped(vector, table))


def backward(vector: list[Cell | None], table: Table) -> list[Cell | None]:
    """Costs and ranks of all ways from the start of a step, from those at its end."""
    out: list[tuple | None] = [None] * 4
    for before in STATES:
        for after, cost, rank in table[before]:
            if vector[after]:
                way = (cost + vector[after][0], rank, vector[after][1])
                if out[before] is None or way < out[before]:
                    out[before] = way
    return _ranked(out)


def only(state: int) -> list[Cell | None]:
    return [(0, 0) if s == state else None for s in STATES]


def crossings(tables: list[Table], start: int, ending: list[Cell | None]) -> list[int]:
    """The state after each step of the cheapest way, of several the one of the first edits."""
    states = [0] * len(tables)

    def solve(low: int, high: int, start: int, ending: list[Cell | None]) -> None:
        if high - low == 1:
            ways = [(cost + ending[q][0], rank, ending[q][1], q) for q, cost, rank in tables[low][start] if ending[q]]
            states[low] = min(ways)[-1]
            return
        middle = (low + high) // 2
        up, down = only(start), ending
        for k in range(low, middle):
            up = forward(up, tables[k])
        for k in range(high - 1, middle - 1, -1):
            down = backward(down, tables[k])
        meeting = [(up[q][0] + down[q][0], up[q][1], down[q][1], q) for q in STATES if up[q] and down[q]]
        state = min(meeting)[-1]
        solve(low, middle, start, only(state))
        solve(middle, high, state, ending)

    if tables:
        solve(0, len(tables), start, ending)
    return states


@lru_cache(65_536)
def edits(classes: bytes, start: int, end: int | None) -> tuple[int, str]:
    """(cost, initials) of the best edits of rows of these classes between two states; ``None`` ends the conversation."""
    cost, found, state = 0, [], start
    for kind, after in zip(classes, crossings([ROW_TABLES[c] for c in classes], start, ENDING if end is None else only(end))):
        price, unit = CLASSES[kind][state, after]
        cost, state = cost + price, after
        found.append(unit)
    if end is None:
        cost += ENDING[state][0]
        found.append("I" * (ENDING[state][0] // INSERT))
    return cost, "".join(found)


def summed_up(classes: bytes) -> Table:
    """The steps of all rows as one step, its ranks those of the edits from and to all states."""
    cells: list[list[Cell | None]] = [only(s) for s in STATES]
    for c in classes:
        stepped = [_stepped(vector, ROW_TABLES[c]) for vector in cells]
        flat = _ranked([cell for vector in stepped for cell in vector])
        cells = [flat[4 * s : 4 * s + 4] for s in STATES]
    return [[(q, *cell) for q, cell in enumerate(vector) if cell] for vector in cells]


# The jobs


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows, as tuples, in runs of the same first ``keys`` values; no run is longer than a block, or a conversation's blocks."""
    rest: list[tuple] = []
    for batch in batches:
        rows = zip(*[c.to_pylist() for c in batch.columns])
        for key, run in groupby(rows, lambda r: r[:keys]):
            run = list(run)
            if rest and rest[-1][:keys] != key:
                yield rest
                rest = []
            rest += run
    if rest:
        yield rest


_PARTS = "conv string, block long, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, classes binary, matrix binary"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, block, initial, blank, duplicate, truncated, turn, class, alone) to one row for each conversation in a block."""
    for run in _runs(batches, 2):
        _, _, initial, blank, duplicate, truncated, turn, kind, alone = zip(*run)
        classes = bytes(kind)
        known = [t for t in turn if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:]))
        matrix = None if alone[0] else pickle.dumps(summed_up(classes))
        counts = (len(run), sum(blank), sum(duplicate), sum(truncated), illegal)
        yield _batch([(*run[0][:2], *counts, initial[0], initial[-1], len(set(known)), min(known, default=None), max(known, default=None), classes, matrix)], _PARTS)


_SOLVED = "conv string, block long, start int, end int, classes binary, gaps long, blank long, duplicate long, truncated long, illegal long"


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a conversation, in order, to the states between them; the counts of all stand in the first."""
    for run in _runs(batches, 1):
        _, block, _, blank, duplicate, truncated, illegal, first, last, turns, low, high, classes, matrix = zip(*run)
        ends: list[int | None] = [None]
        if len(run) > 1:
            ends = [*crossings([pickle.loads(m) for m in matrix], 0, ENDING)[:-1], None]
        between = sum(a + b not in ("su", "ua", "au") for a, b in zip(last, first[1:]))
        # Turns are in order, so only the last of a part can be met again in the next.
        distinct = sum(turns) - sum(a is not None and a == b for a, b in zip(high, low[1:]))
        known = [t for t in (*low, *high) if t is not None]
        gaps = max(known) - min(known) + 1 - distinct if known else 0
        counts = [(gaps, sum(blank), sum(duplicate), sum(truncated), sum(illegal) + between)] + [(0,) * 5] * (len(run) - 1)
        yield _batch([(run[0][0], b, s, e, c, *n) for b, s, e, c, n in zip(block, [0, *ends[:-1]], ends, classes, counts)], _SOLVED)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [edits(c, s, e) for c, s, e in zip(*[batch.column(n).to_pylist() for n in ("classes", "start", "end")])]
        out = batch.drop_columns(["classes", "end"])
        yield out.append_column("cost", pa.array([c for c, _ in found], pa.int64())).append_column("audit", pa.array([a for _, a in found], pa.string()))


_REPAIRED = "conv string, pos long, part int, role string, text string, edit string"


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, block, pos, start, audit, role, text), a part's audit before its rows, to what is left of them."""
    rest, state, last = iter(()), 0, None
    for batch in batches:
        out: list[tuple] = []

        def inserts(until_row: bool) -> str | None:
            """Emits the inserts that are due; then the edit of the row, if one follows."""
            nonlocal state
            for part, edit in enumerate(rest):
                if edit != "I":
                    return edit
                initial, state = _inserted(state)
                out.append((last[0], last[1], part + (0 if until_row else 1 << 16), ROLES[initial], "", "I"))
            return None

        for conv, _, pos, start, audit, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if audit is not None:
                inserts(False)
                rest, state = iter(audit), start
                continue
            last = (conv, pos)
            edit = inserts(True)
            if edit == "R":
                initial = next(i for i in ROLES if i in NEXT[state])
                role = ROLES[initial]
            if edit in ("K", "R"):
                state = NEXT[state][role[0]]
                out.append((conv, pos, 1 << 15, role, text, edit))
        yield _batch(out, _REPAIRED)
    if last is not None:
        out = []
        inserts(False)
        yield _batch(out, _REPAIRED)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, role, text) in order to one digest for each conversation, without holding its texts."""
    conv, digest = None, None
    for batch in batches:
        out = []
        for now, role, text in zip(*[c.to_pylist() for c in batch.columns]):
            if now != conv:
                if conv is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = now, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield _batch(out, "conv string, repaired_sha256 string")
    if conv is not None:
        yield _batch([(conv, digest.hexdigest())], "conv string, repaired_sha256 string")


@dataclass
class Repair:
    """``report``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows.

    ``repaired``: (conv, pos, part, role, text, edit), its rows after the repair in the order of ``pos`` and ``part``.
    ``conv`` is the id as text behind a ``=``; for a null id it is empty.
    """

    report: DataFrame
    repaired: DataFrame


def conversation_key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(conversations: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bits: int = BLOCK_BITS) -> Repair:
    """The cheapest edits that give every conversation a sound structure, and the rows after them.

    Rows of a conversation go by turn, nulls first, then by role and text; a null role or text
    is one space, and null ids are one conversation. Equal rows repeat one another. An empty table gives no
    rows. Other columns are ignored, whatever their names. Blocks have ``2 ** bits`` rows.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = conversations.select(conversation_key(F.col(conv_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # The bounds of the ranges are made of short keys; equal rows are spread by the last one.
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]
    ranged = rows.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("_spread")).sortWithinPartitions(*order)
    rows = scratch.keep(ranged.drop("_spread").withColumn("pos", F.monotonically_increasing_id()), "turns")

    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    facts = rows.select(
        "conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("cut"), content.alias("content")
    )
    facts = scratch.keep(facts, "turn-facts")
    again = facts.filter("NOT blank").groupBy("conv", "content").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    facts = facts.join(again, ["conv", "content"], "left")
    duplicate = F.coalesce(~F.col("blank") & (F.col("pos") > F.col("_first")), F.lit(False))
    block = F.shiftright("pos", bits)
    facts = facts.select("conv", block.alias("block"), "pos", "initial", "blank", duplicate.alias("duplicate"), (F.col("cut") & ~F.col("blank") & ~duplicate).alias("truncated"), "turn")
    # A conversation that lies in one block needs no matrix.
    spread = scratch.keep(facts.groupBy("conv").agg(F.min("block").alias("_low"), F.max("block").alias("_high")).filter("_low <> _high").select("conv", F.lit(True).alias("_spread")), "spread")
    fault = F.when(F.col("blank") | F.col("duplicate"), CONDEMNED).when(F.col("truncated"), CUT).otherwise(SOUND)
    kind = 3 * (F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.col("initial")) * (F.col("initial") != "").cast("int"), F.lit(0)), F.lit(4)) - 1) + fault
    dealt = facts.join(spread, "conv", "left").withColumns({"kind": kind.cast("int"), "alone": F.col("_spread").isNull()})
    dealt = dealt.repartition("block").sortWithinPartitions("pos").select("conv", "block", "initial", *[F.col(c).cast("int").alias(c) for c in ("blank", "duplicate", "truncated")], "turn", "kind", "alone")
    parts = scratch.keep(dealt.mapInArrow(_parts, _PARTS), "parts")
    crossed = parts.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_crossed, _SOLVED)
    audited = crossed.repartition("conv", "block").mapInArrow(_audited, "conv string, block long, start int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    audited = scratch.keep(audited, "audited")

    pieces = F.array_sort(F.collect_list(F.struct("block", "audit")))
    report = audited.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit")
    )
    texts = rows.select("conv", block.alias("block"), "pos", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("audit"), "role", "text")
    heads = audited.select("conv", "block", F.lit(-1).cast("long").alias("pos"), "start", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = texts.unionByName(heads).repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")
    return Repair(report, both.mapInArrow(_applied, _REPAIRED))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the hash of ``role:text`` of all rows in order, joined by line ends.

    A hash is made from first to last, so the texts of a conversation pass through one task, a row at a time.
    """
    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "pos", "part").select("conv", "role", "text")
    return ordered.mapInArrow(_digested, "conv string, repaired_sha256 string")


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults that a checksum of id and turn chooses: dropped, emptied, without sentence ends, repeated, or of role user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    rows = conversations.select(
        conv_col,
        turn_col,
        F.when(fault == 4, "user").otherwise(role).alias(role_col),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.withColumn("_times", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).drop("_times")


def repair_damaged(conversations: DataFrame, scratch: Scratch, conv_col: str = "conv_id") -> DataFrame:
    """Every conversation of the table with the report and the digest of the repair of its damaged rows."""
    found = repair(damaged(conversations, conv_col), scratch, conv_col)
    every = conversations.select(conv_col).distinct().withColumn("conv", conversation_key(F.col(conv_col)))
    out = every.join(found.report, "conv", "left").join(digests(found.repaired), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(conv_col, *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
