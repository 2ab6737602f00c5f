import pytest
from pyspark.sql import functions as F

from timberline.functions.keys import sanitize_key, sanitized
from timberline.functions.levels import level_rank
from timberline.functions.text import glob_match, lenient_int
from timberline.operators.generic import parse_generic


def test_any_line_is_a_row(lines):
    rows = parse_generic(lines("the tide turned at noon", "", "  ")).orderBy("line_no").collect()
    assert [r["message"] for r in rows] == ["the tide turned at noon", "", "  "]
    assert [r["level"] for r in rows] == ["info"] * 3 and rows[0]["raw"] == "the tide turned at noon"


@pytest.mark.parametrize(
    "text, level",
    [
        ("CRITICAL", "fatal"), ("criteria", "fatal"), ("an Emergency", "fatal"), ("interrupt", "error"),
        ("failed, warned", "error"), ("Exception", "error"), ("[WARN] x", "warning"), ("notice", "notice"),
        ("for your information", "info"), ("dbg", "debug"), ("verbose", "trace"), ("[E] x", "error"), ("[W]", "warning"),
        ("[e]", "info"), ("plain", "info"),
    ],
)
def test_level(lines, text, level):
    assert parse_generic(lines(text)).first()["level"] == level


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1700000000", "2023-11-14T22:13:20.000Z"),
        (" 1700000000123 ", "2023-11-14T22:13:20.123Z"),
        ("999999999999", "+033658-09-27T01:46:39.000Z"),
        ("170000000", None),
        ("17000000001234", None),
        ("2024-01-01T10:00:00", "2024-01-01T10:00:00.000Z"),
        ("2024-01-01T10:00:00.5Z", "2024-01-01T10:00:00.500Z"),
        ("2024-02-30T10:00:00+02:00", "2024-03-01T08:00:00.000Z"),
        ("2024-01-01T24:00:00Z", "2024-01-02T00:00:00.000Z"),
        ("2024-01-01T24:00:01Z", None),
        ("2024-13-01T10:00:00Z", None),
        ("2024-01-01T10:00:00 ERROR x", None),
        ("Apr 28 04:02:03 foo", "2024-04-28T04:02:03.000Z"),
        ("Apr 31 25:02:03", "2024-05-02T01:02:03.000Z"),
        ("Foo 28 04:02:03 foo", None),
        ("2024-05-06", "2024-05-06T00:00:00.000Z"),
        ("2024-05-06 07:08:09", "2024-05-06T07:08:09.000Z"),
        ("2024/05/06 07:08:09", "2024-05-06T07:08:09.000Z"),
        ("2024-05/06 07:08:09", None),
        ("Thu, 10 Oct 2000 01:02:03 +0100", "2000-10-10T00:02:03.000Z"),
        ("10 Oct 2000 01:02:03 GMT", "2000-10-10T01:02:03.000Z"),
    ],
)
def test_timestamp(lines, at, text, expected):
    assert parse_generic(lines(text), at("2024-10-12 00:00:00")).first()["timestamp"] == expected


def test_session_time_zone_does_not_matter(spark, lines, at):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = parse_generic(lines("2024-03-10T02:30:00Z", "1710037800"), at("2024-10-12 00:00:00")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r["timestamp"] for r in rows] == ["2024-03-10T02:30:00.000Z"] * 2


@pytest.mark.parametrize(
    "key, name",
    [("a.b-c", "a_b_c"), ("__X__", "x"), ("", "value"), ("é", "value"), ("9lives", "field_9lives"), ("RAW", "json_raw"), ("line-no", "json_line_no")],
)
def test_sanitize(spark, key, name):
    assert spark.createDataFrame([(key,)], "k string").select(sanitize_key(F.col("k"))).first()[0] == name
    assert sanitized([key]) == name


@pytest.mark.parametrize("text, number", [("12abc", 12), (" 7", 7), ("-3.9", -3), ("-", None), ("", None), ("x1", None), ("+5", 5)])
def test_lenient_int(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(lenient_int(F.col("t"))).first()[0] == number


def test_level_rank(spark):
    levels = ["fatal", "critical", "error", "warning", "notice", "info", "debug", "trace", "unknown"]
    df = spark.createDataFrame([(level,) for level in levels + ["other"]], "level string")
    assert [r[0] for r in df.select(level_rank(F.col("level"))).collect()] == [0, 1, 2, 3, 4, 5, 6, 7, 8, None]


@pytest.mark.parametrize(
    "pattern, text, hit",
    [("/a*", "/abc", True), ("/a*", "x/abc", False), ("?b", "ab", True), ("[a-c]x", "bx", True), ("[^a]x", "ax", False),
     ("a.c", "abc", False), ("A*", "abc", False), ("[", "[", True)],
)
def test_glob(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(glob_match(F.col("t"), pattern)).first()[0] is hit
