import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from timberline.llm import hirschberg_repair as hr
from timberline.llm.common import Scratch

DDL = "conv_id long, turn long, role string, text string, conv string, pos int"
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def faults_of(rows):
    """blank, duplicate, truncated or nothing for each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows):
    """(cost, audit, texts) by plain shortest paths that carry all edits with them."""
    ways = {"": (0, "", ())}
    faults = [*faults_of(rows), None]
    for (role, text), fault in zip([*rows, ("", "")], faults):
        changed = True
        while changed:  # inserts
            changed = False
            for state, (cost, audit, out) in list(ways.items()):
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in AFTER[state]:
                        way = (cost + 5, audit + "I", (*out, f"{name}:"))
                        if way < ways.get(initial, (1 << 60,)):
                            ways[initial], changed = way, True
        if fault is None:
            break
        following = {}
        for state, (cost, audit, out) in ways.items():
            steps = [(state, (cost + 2, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in AFTER[state]:
                    steps.append((role[:1], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in AFTER[state]:
                        steps.append((initial, (cost + more + 1, audit + "R", (*out, f"{name}:{text}"))))
            for to, way in steps:
                following[to] = min(following.get(to, way), way)
        ways = following
    return min(w for s, w in ways.items() if s in ("", "a"))


def plain(rows):
    """The report of every conversation, by its definition."""
    convs, out = defaultdict(list), []
    every = {r[0] for r in rows}
    for conv, turn, role, text, *_ in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv in every:
        found = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in found if t is not None]
        texts = [r[1:] for r in found]
        faults = faults_of(texts)
        cost, audit, kept = cheapest(texts)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(texts, texts[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "usher", "", None, "A"]
    texts = ["Yes.", "No!", "why", "cut off,", " \x0b", "", None, "ß?\n\t", "x" * 30 + "."]
    for conv in range(conversations):
        for turn in range(rng.randrange(longest)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}{rng.choice(['.', '!', '', ' and'])}"
            rows.append((conv if conv else None, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.95 else None, rng.choice(roles), text, "x", -1))
    return rows


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_against_all_ways(spark, bits, monkeypatch):
    monkeypatch.setattr(hr.repair, "__defaults__", (*hr.repair.__defaults__[:-1], bits))
    rows = random_rows(bits, 150, 14) + [(900, 1, "user", "One.", None, 0)] * 3
    rows += [(901, k, ["user", "assistant", "assistant"][k % 3], f"{k}{'.?,'[k % 3]}", "x", 1) for k in range(400)]
    found = hr.repair_damaged(spark.createDataFrame(rows, DDL).repartition(5), Scratch(spark))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_crossings_give_the_first_of_the_cheapest_edits():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b.", "c", "", f"{rng.random()}."])) for _ in range(rng.randrange(12))]
        kind = {"": hr.SOUND, "truncated": hr.CUT}
        classes = bytes(3 * "suat".index(role[0]) + kind.get(fault, hr.CONDEMNED) for (role, _), fault in zip(rows, faults_of(rows)))
        assert hr.edits(classes, 0, None) == cheapest(rows)[:2]


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "A.", "x", 0), (1, 1, "user", "B.", "x", 0), (2, 0, "user", "", "x", 0)]
    found = hr.repair(spark.createDataFrame(rows, DDL), Scratch(spark))
    assert [tuple(r)[3:] for r in found.repaired.orderBy("conv", "pos", "part").collect()] == [("user", "A.", "R"), ("assistant", "B.", "R")]
    assert sorted((r.conv, r.cost, r.audit) for r in found.report.collect()) == [("=1", 2, "RR"), ("=2", 2, "D")]


def test_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"{k}.", "x", 0) for k in range(20_000)]
    found = hr.repair(spark.createDataFrame(rows, DDL), Scratch(spark))
    assert found.report.select("cost", "audit").collect() == [(0, "K" * 20_000)]
    assert found.repaired.count() == 20_000


def test_empty(spark):
    assert hr.repair_damaged(spark.createDataFrame([], DDL), Scratch(spark)).collect() == []
