import random
import re

import pytest

from timberline.operators.journald import assemble_journald, parse_journald

KEYS = ["__REALTIME_TIMESTAMP", "_HOSTNAME", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "_PID", "PRIORITY", "MESSAGE"]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_key_values(lines):
    row = one(parse_journald(lines("__REALTIME_TIMESTAMP=1700000000000000\n_HOSTNAME=depot\nMESSAGE=lamp lit")))
    assert row["hostname"] == "depot" and row["message"] == "lamp lit"
    assert row["timestamp"] == "2023-11-14T22:13:20.000Z"


def test_continuation(lines):
    row = one(parse_journald(lines("__REALTIME_TIMESTAMP=1700000000000000\nMESSAGE=lamp\n lit")))
    assert row["message"] == "lamp\nlit"


def test_last_duplicate_wins_and_first_equals_splits(lines):
    row = one(parse_journald(lines("MESSAGE=a\nMESSAGE=b=c\nPRIORITY=6abc\n_PID= 7\n_SYSTEMD_UNIT=")))
    assert (row["message"], row["priority"], row["pid"], row["unit"]) == ("b=c", 6, 7, "")


@pytest.mark.parametrize(
    "digits, expected",
    [
        ("123", "1970-01-01T00:00:00.123Z"),
        ("1700000000000", "2023-11-14T22:13:20.000Z"),
        ("1700000000000999", "2023-11-14T22:13:20.000Z"),
        ("12x", None),
        ("", None),
        ("9999999999999999999", None),
    ],
)
def test_epoch(lines, digits, expected):
    assert one(parse_journald(lines(f"__REALTIME_TIMESTAMP={digits}")))["timestamp"] == expected


@pytest.mark.parametrize("text", ["", "  ", "no equals", "MESSAGE=a\nno equals", "=v\n  no equals", '{"x":1}', "{bad", "[1]"])
def test_skipped(lines, text):
    assert parse_journald(lines(text)).count() == 0


def test_after_an_empty_key_nothing_continues(lines):
    row = one(parse_journald(lines("=v\n  MESSAGE=x\n more\nMESSAGE=y")))
    assert row["message"] == "y"


def test_json(lines):
    rows = parse_journald(
        lines(
            ' {"MESSAGE":[104,105],"PRIORITY":"3","_PID":7.9,"__REALTIME_TIMESTAMP":"1700000000000000"} ',
            '{"PRIORITY":null}',
            '{"MESSAGE":"only"}',
            '{"PRIORITY":true,"_SYSTEMD_UNIT":5,"_HOSTNAME":{"a":1}}',
        )
    ).orderBy("line_no").collect()
    assert [r["message"] for r in rows] == ["[104,105]", None, "only", None]
    assert (rows[0]["priority"], rows[0]["pid"], rows[0]["timestamp"]) == (3, 7, "2023-11-14T22:13:20.000Z")
    assert (rows[3]["priority"], rows[3]["unit"], rows[3]["hostname"]) == (None, "5", '{"a":1}')


def brute_force(texts):
    """Records as (first line, text), one line after the other."""
    if any(t.strip().startswith("{") for t in texts):
        return [(n, t) for n, t in enumerate(texts, 1) if t.strip()]
    records, open_record = [], None
    for n, text in enumerate(texts, 1):
        if not text.strip():
            open_record = None
        elif open_record is not None and (text[0].isspace() or re.match("(?:%s)=" % "|".join(KEYS), text)):
            open_record[1].append(text)
        else:
            open_record = (n, [text])
            records.append(open_record)
    return [(n, "\n".join(parts)) for n, parts in records]


@pytest.mark.parametrize("seed, block", [(1, 1), (2, 2), (3, 7), (4, 50), (5, 3)])
def test_assembly_across_blocks(spark, seed, block):
    choice = random.Random(seed)
    kinds = ["MESSAGE=a", "PRIORITY=3", " indented", "\tindented", "", "  ", "_TRANSPORT=x", "loose text", "_PID=1"]
    files = {f"f{i}": [choice.choice(kinds) for _ in range(60)] for i in range(4)}
    files["json"] = ["MESSAGE=a", " b", "", '  {"a":1}', "c"]
    files["blank"] = ["", " "]
    rows = [(f, (n - 1) // block, n, t) for f, texts in files.items() for n, t in enumerate(texts, 1)]
    df = spark.createDataFrame(rows, "file string, block long, line_no long, raw string").repartition(5)
    got = sorted((r["file"], r["line_no"], r["raw"]) for r in assemble_journald(df).collect())
    assert got == sorted((f, n, t) for f, texts in files.items() for n, t in brute_force(texts))


def test_strict_blocks_end_at_blank_lines_only(lines):
    records = assemble_journald(lines("__CURSOR=x", "MESSAGE=a", "_TRANSPORT=y", "", "MESSAGE=b"), strict_blocks=True)
    assert sorted(r["raw"] for r in records.collect()) == ["MESSAGE=b", "__CURSOR=x\nMESSAGE=a\n_TRANSPORT=y"]
