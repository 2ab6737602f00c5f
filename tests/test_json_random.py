"""JSON columns against a plain reading of the same records, one by one."""

import json
import random
import re

import pytest

from timberline.operators.json_lines import parse_json

TARGETS = {"timestamp": ["@timestamp", "timestamp", "time", "ts"], "level": ["level", "severity", "lvl"], "message": ["message", "msg"]}
KEYS = ["a", "a-b", "a_b", "b", "A B", "level", "Level", "lvl", "msg", "message", "ts", "@timestamp", "timestamp", "c.d"]


def name(key):
    return re.sub("[^a-z0-9]+", "_", key.lower()).strip("_")


def number(value):
    return str(int(value)) if value == int(value) else repr(value)


def value(choice, depth):
    kind = choice.choice("sinbtlo" if depth < 3 else "sinbt")
    return {
        "s": lambda: choice.choice(["x", "", "é", "7"]),
        "i": lambda: choice.choice([0, 5, -12]),
        "n": lambda: choice.choice([None, None, 2.5, 3.0]),
        "b": lambda: True,
        "t": lambda: False,
        "l": lambda: choice.choice([[], [1, "a"], [{"z": 1, "a": [2]}]]),
        "o": lambda: {k: value(choice, depth + 1) for k in choice.sample(KEYS, choice.randrange(3))},
    }[kind]()


def leaves(record, path=""):
    for key, item in record.items():
        full = f"{path}_{key}" if path else key
        if isinstance(item, dict) and item:
            yield from leaves(item, full)
        elif isinstance(item, (list, dict)):
            yield name(full), json.dumps(item, separators=(",", ":"), ensure_ascii=False)
        else:
            yield name(full), int(item) if isinstance(item, bool) else item


def promoted(record, flat, target):
    for key in TARGETS[target]:
        item = record.get(key, ...)
        if item is None:
            break
        if isinstance(item, str):
            return item
        if isinstance(item, (int, float)) and not isinstance(item, bool):
            return number(item)
    for key in TARGETS[target]:
        item = flat.get(name(key))
        if isinstance(item, str):
            return item
        if item is not None and target != "message":
            return number(item)
    return None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_records(lines, seed):
    choice = random.Random(seed)
    records = [{k: value(choice, 1) for k in choice.sample(KEYS, choice.randrange(1, 6))} for _ in range(150)]
    df = parse_json(lines(*[json.dumps(r, ensure_ascii=False) for r in records]))
    flat = [dict(leaves(r)) for r in records]
    hidden = {name(k) for keys in TARGETS.values() for k in keys}
    columns = sorted({k for f in flat for k in f} - hidden, key=lambda k: k.replace("_", " "))
    assert df.columns[3:] == ["timestamp", "level", "message", *columns]
    kinds = dict(df.dtypes)
    for row, record, cells in zip(df.orderBy("line_no").collect(), records, flat):
        for target in TARGETS:
            assert row[target] == promoted(record, cells, target), (target, record)
        for column in columns:
            expected = cells.get(column)
            if kinds[column] == "string" and isinstance(expected, (int, float)):
                expected = number(expected)
            assert row[column] == expected, (column, record)
