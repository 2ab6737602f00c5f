import re
from collections import defaultdict

import pytest

from timberline.llm import cube_mixing
from timberline.llm.common import Scratch
from timberline.llm.cube_mixing import flight, land, mix, uniform


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, 7) for r in rows], "doc_id long, text string, source string, size long, chance int")


def filled(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left = {}, dict.fromkeys(names)
    while True:
        rest = budget * sum(sizes.values()) - sum(full.values())
        total = sum(weight[s] for s in left) or 1
        above = [s for s in left if rest * weight[s] / total > most * sizes[s]]
        if not above:
            return {**full, **{s: rest * weight[s] / total for s in left}}
        for s in above:
            full[s] = most * sizes[s]
            left.pop(s)


def test_flight_keeps_both_sums():
    draws = uniform("t")
    sizes = [int(next(draws) * 500) + 1 for _ in range(400)]
    chances = [next(draws) for _ in sizes]
    moved = flight(chances, sizes, draws)
    assert sum(0 < p < 1 for p in moved) <= 2
    assert abs(sum(moved) - sum(chances)) < 1e-6
    assert abs(sum(p * s for p, s in zip(moved, sizes)) - sum(p * s for p, s in zip(chances, sizes))) < 1e-3
    assert set(land(moved, sizes, draws)) <= {0.0, 1.0}
    assert land([0.5], [3], draws)[0] in (0.0, 1.0) and flight([], [], draws) == []


def test_flight_is_unbiased():
    sizes, chances = [5, 9, 14, 30, 2, 2], [0.2, 0.5, 0.7, 0.4, 0.9, 0.3]
    runs = [land(flight(chances, sizes, d), sizes, d) for d in (uniform(str(k)) for k in range(4000))]
    for k, p in enumerate(chances):
        assert abs(sum(r[k] for r in runs) / len(runs) - p) < 0.04


@pytest.mark.parametrize("block", [16, 4096])
def test_targets_are_met(spark, monkeypatch, block):
    monkeypatch.setattr(cube_mixing, "BLOCK", block)
    names = ["a", "b", "ä", None, "z", "empty", "\U0001f600"]
    rows = [(k, " w" * (k * 37 % 91 + 1), names[k % 7 if k % 3 else 0]) for k in range(600)]
    rows = [(k, None if s == "empty" else t, s) for k, t, s in rows]
    out = mix(docs(spark, rows), Scratch(spark)).collect()
    again = mix(docs(spark, rows[::-1]).repartition(3), Scratch(spark)).collect()
    assert sorted(out) == sorted(again) and len(out) == len(rows)
    size, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in out:
        _, text, source = rows[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) and 0 <= r.taken <= 2 * r.size
        size[source] += r.size
        taken[source] += r.taken
        goal[source] = (r.source_size, r.target)
    expected = filled(size)
    for s in names:
        assert goal[s][0] == size[s] and abs(goal[s][1] - expected[s]) < 1e-6
        assert abs(taken[s] - expected[s]) <= 92


def test_empty_and_repeated(spark):
    assert mix(docs(spark, []), Scratch(spark)).collect() == []
    rows = [(1, "a b", "s")] * 4 + [(None, "", "s"), (None, None, None)]
    out = mix(docs(spark, rows), Scratch(spark)).collect()
    assert sum(r.taken for r in out) == 12 and len(out) == 6
