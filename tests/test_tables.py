import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from timberline.operators.access import parse_nginx
from timberline.operators import results
from timberline.operators.dml import delete_where, insert_rows, update_where
from timberline.operators.frames import with_frame
from timberline.operators.json_lines import discover_columns, parse_json
from timberline.operators.membership import not_in, with_not_in
from timberline.operators.results import (
    decode_binary_columns,
    deep_page,
    export_csv,
    page,
    page_info,
    recent_distinct,
    table_info,
)
from timberline.operators.summary import load_summary
from timberline.operators.syslog import parse_syslog
from timberline.operators.time_joins import asof_join, overlap_join, range_join, with_previous
from timberline.plans import canned
from timberline.streaming.tail import tail_logs

FORMATS = ["nginx_access", "apache_access", "syslog", "journald", "json", "generic"]


def test_pages(spark):
    df = spark.range(250).withColumnRenamed("id", "line_no")
    assert [r[0] for r in page(df, 2, ["line_no"]).collect()] == list(range(200, 250))
    assert page_info(df, 2) == {"start": 200, "end": 250, "total": 250, "pages": 3}
    assert page_info(df.limit(0), 0) == {"start": 0, "end": 0, "total": 0, "pages": 0}


def test_csv_text(spark, tmp_path):
    rows = [(1, 'a,"b"\nc'), (2, None), (3, "  x "), (4, "")]
    df = spark.createDataFrame(rows, "n int, t string").coalesce(1)
    assert export_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text() == 'n,t\n1,"a,""b""\nc"\n2,\n3,  x \n4,\n'
    assert not export_csv(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()


def test_binary_columns(spark):
    df = spark.createDataFrame([(b"ok\xff",), (b"",), (None,)], "b binary")
    assert [r[0] for r in decode_binary_columns(df).collect()] == ["ok" + chr(0xFFFD), "", None]


def test_recent_distinct(spark):
    df = spark.createDataFrame([(i, f"q{i % 15}", f"g{i % 2}") for i in range(100)], "at int, sql string, who string")
    assert [r["sql"] for r in recent_distinct(df, "sql", "at").collect()] == [f"q{i % 15}" for i in range(99, 89, -1)]
    per = recent_distinct(df, "sql", "at", n=2, per="who").collect()
    assert sorted((r["who"], r["at"]) for r in per) == [("g0", 96), ("g0", 98), ("g1", 97), ("g1", 99)]


def test_table_info(spark):
    df = spark.createDataFrame([(1, 1.0, "x", True)], "a int, b double, c string, d boolean")
    assert [tuple(r) for r in table_info(df).orderBy("cid").collect()] == [(0, "a", "INTEGER"), (1, "b", "REAL"), (2, "c", "TEXT"), (3, "d", "INTEGER")]


def test_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "n bigint, t string")
    assert [r["n"] for r in delete_where(df, F.col("t") == "a").orderBy("n").collect()] == [2, 3]
    changed = update_where(df, F.col("n") >= 2, {"n": F.col("n") * 10, "t": F.col("n").cast("string")})
    assert [tuple(r) for r in changed.orderBy("n").collect()] == [(1, "a"), (20, "2"), (30, "3")]
    assert [tuple(r) for r in insert_rows(df, spark.createDataFrame([(9,)], "n bigint")).filter("n = 9").collect()] == [(9, None)]


def _times(choice, n, day=1):
    return [dt.datetime(2024, 1, day) + dt.timedelta(seconds=choice.randrange(6 * 3600)) for _ in range(n)]


def test_previous_and_asof_match_brute_force(spark):
    choice = random.Random(3)
    left = [(choice.choice("aab"), i, t) for i, t in enumerate(_times(choice, 120))]
    right = [(choice.choice("aac"), i, t) for i, t in enumerate(_times(choice, 60))]
    lefts = spark.createDataFrame(left, "k string, n int, at timestamp")
    rights = spark.createDataFrame(right, "k string, m int, seen timestamp")

    ordered = sorted(left, key=lambda r: (r[0], r[2], r[1]))
    before = {row[1]: (p[1] if p and p[0] == row[0] else None) for p, row in zip([None] + ordered, ordered)}
    got = with_previous(lefts, ["k"], ["at", "n"], "n", "last", seconds=900).collect()
    assert {r["n"]: r["last"] for r in got} == before

    best = {n: max((s for key, _, s in right if key == k and s <= t), default=None) for k, n, t in left}
    got = asof_join(lefts, rights, ["k"], "at", "seen", seconds=900).collect()
    assert {r["n"]: r["seen"] for r in got} == best and len(got) == len(left)


@pytest.mark.parametrize("seconds", [None, 600, 7200])
def test_nulls_in_previous_and_asof(spark, seconds):
    choice = random.Random(8)
    some = lambda values: choice.choice([*values, None])
    rows = [(some("ab"), n, some(_times(choice, 5)), some([n])) for n in range(150)]
    df = spark.createDataFrame(rows, "k string, n int, at timestamp, v int")
    first = lambda x: (x is not None, x)
    ordered = sorted(rows, key=lambda r: (str(r[0]), first(r[2]) if r[2] else (False,), r[1]))
    before = {b[1]: (a[3] if a and a[0] == b[0] else None) for a, b in zip([None, *ordered], ordered)}
    got = with_previous(df, ["k"], ["at", "n"], "v", "last", seconds=seconds).collect()
    assert {r["n"]: r["last"] for r in got} == before

    rights = spark.createDataFrame([(some("ac"), some(_times(choice, 5)), n) for n in range(60)], "k string, seen timestamp, m int")
    known = [r for r in rights.collect() if r["k"] is not None and r["seen"] is not None]
    best = {n: max((r["seen"] for r in known if r["k"] == k and at and r["seen"] <= at), default=None) for k, n, at, _ in rows}
    got = asof_join(df, rights, ["k"], "at", "seen", seconds=seconds).collect()
    assert {r["n"]: r["seen"] for r in got} == best and len(got) == len(rows)


@pytest.mark.parametrize("seconds", [None, 1])
def test_range_join_matches_brute_force(spark, seconds):
    choice = random.Random(5)
    points = [(i, t) for i, t in enumerate(_times(choice, 200))] + [(999, None)]
    lengths = [0, 1e-6, 60, 5000, 400 * 86400]
    spans = [(i, t, t + dt.timedelta(seconds=choice.choice(lengths))) for i, t in enumerate(_times(choice, 20))]
    spans += [(90, dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)), (91, None, dt.datetime(2100, 1, 1))]
    got = range_join(
        spark.createDataFrame(points, "p int, at timestamp"),
        spark.createDataFrame(spans, "s int, begins timestamp, ends timestamp"),
        [], "at", "begins", "ends", seconds=seconds,
    )
    points, spans = [x for x in points if x[1]], [x for x in spans if x[1]]
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((p, s) for p, t in points for s, b, e in spans if b <= t < e)


def test_suggestions():
    for name in FORMATS:
        assert len(canned.suggested_queries(name)) >= 5 and all("logs" in c.sql for c in canned.suggested_queries(name))
    assert [c.label for c in canned.quick_queries("nginx_access")][0] == "Status breakdown" and len(canned.quick_queries("json")) == 3
    labels = [c.label for c in canned.suggested_queries("json", ["line_no", "raw", "level"])]
    assert labels == ["By level", "First 100 rows", "Errors", "Row count", "Schema columns"]
    assert canned.suggested_queries("json", ["timestamp"])[0].label == "First 100 rows"
    assert canned.suggested_queries("something") == canned.GENERIC


def test_summary(lines):
    df = lines('h - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.1" 200 5', "", "bad")
    assert tuple(load_summary(df, "nginx_access").first()) == ("f", "nginx_access", 1, 2)
    assert tuple(load_summary(df, "generic").first()) == ("f", "generic", 3, 0)


def test_one_parse_per_line(lines, capsys):
    """A filter and a sort on parsed columns leave one capture and one object parse in the plan."""
    hit = parse_nginx(lines("x")).filter("status >= 500 AND path LIKE '/a%'").orderBy("timestamp")
    hit.explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(raw") == 2 and "RLIKE(raw" not in plan  # the plain and the wide form
    parse_syslog(lines("x")).filter("severity <= 3").explain()
    plan = capsys.readouterr().out
    assert plan.count("regexp_replace(raw") == 2 and "RLIKE(raw" not in plan
    rows = lines('{"level":"a","msg":"b"}')
    parse_json(rows, discover_columns(rows)).filter("level = 'a' AND message = 'b'").explain()
    assert capsys.readouterr().out.count("concat([, raw") == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('h - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.1" 503 5\nbad\n')
    stream = tail_logs(spark, str(tmp_path / "in"), "nginx_access")
    query = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    (tmp_path / "in" / "b.log").write_text('h - - [10/Oct/2000:13:55:37 -0700] "GET / HTTP/1.1" 200 5\n')
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("SELECT status, event_time FROM tailed ORDER BY status").collect()
    assert [r["status"] for r in rows] == [200, 503] and rows[0]["event_time"] is not None
    with pytest.raises(ValueError):
        tail_logs(spark, str(tmp_path), "journald")


def test_sqlite_names_match_sqlite(spark):
    """Against the database that the names come from."""
    import sqlite3

    from timberline.functions.sql_names import register_functions
    from timberline.functions.text import glob_match

    register_functions(spark)
    plain = sqlite3.connect(":memory:")

    def both(text, *values):
        mine = spark.sql("SELECT " + text, args=list(values)).first()[0]
        theirs = plain.execute("SELECT " + text, values).fetchone()[0]
        return mine, theirs

    globs = ["[^a]*", "a?s:b", "*", "?", "a.b", "[a-c]x", "[^a-c]x", "a*b*c", "é?", "[]]", "[^]]", "(+)", "a\\b", "[.]", "[*]"]
    texts = ["bcd", "abc", "axs:b", "a.b", "axb", "bx", "dx", "aXbYc", "éa", "]", "(+)", "a\\b", ".", "*", "", "a\nb"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for pattern in globs:
        theirs = [bool(plain.execute("SELECT ? GLOB ?", (x, pattern)).fetchone()[0]) for x in texts]
        quoted = pattern.replace("\\", "\\\\")
        assert [r[0] for r in df.selectExpr(f"glob('{quoted}', x)").collect()] == theirs, pattern
        assert [r[0] for r in df.select(glob_match(F.col("x"), pattern)).collect()] == theirs, pattern
    at = "2024-02-03 04:05:06"
    for code in ["%Y-%m-%dT%H:%M:%S", "%s", "%w", "%Y year", "100%%", "%j'quoted'", "a%fb", "", "%H%M"]:
        mine, theirs = both("strftime(?, ?)", code, at)
        assert mine == theirs, code
    for text in ['{"a":1}', '{"a":1} x', "[1] 2", "1", '"s"', "nope", "", "null", "[1,2]", "1,2", '{"a":1},{"b":2}', "[", "true"]:
        mine, theirs = both("json_valid(?)", text)
        assert bool(mine) == bool(theirs), text
    for text in ["1", "1.5", '"s"', "null", "true", "false", "[1]", '{"a":1}']:
        mine, theirs = both("json_type(?)", text)
        assert mine == theirs, text
    assert spark.sql("SELECT if(1 < 2, 1, 0) + 1").first()[0] == 2


def test_date_modifiers_match_sqlite(spark):
    """Against the database that the modifiers come from."""
    import sqlite3

    from timberline.functions.sql_names import register_functions

    register_functions(spark)
    plain = sqlite3.connect(":memory:")
    times = ["2024-01-31 23:59:58", "2024-02-29", "1999-12-31T12:30:00", "2023-03-01 00:00:00.500", "07:15", "nonsense", "1700000000", "2460000.25", "-1"]
    modifiers = [
        (), ("+1 day",), ("-1 day",), ("+1 month",), ("-13 months",), ("+1 year",), ("-4 years",), ("start of month",), ("start of year",), ("start of day",),
        ("weekday 1",), ("weekday 0",), ("start of month", "+1 month", "-1 day"), ("start of year", "+9 months", "weekday 2"), ("unixepoch",), ("unixepoch", "+90 minutes"),
        ("+1.5 days",), ("1.5 hours",), ("+2.5 months",), ("-00:30",), ("+26:61:01", ), ("+10:20:30.5",), ("auto",), ("utc",), ("no such",), ("START OF DAY", "+30 seconds"), ("julianday",),
    ]
    # Of a number that is no Julian day, 'utc' makes a date before all dates there.
    rows = [(t, list(m)) for t in times for m in modifiers if (t, m) not in (("1700000000", ("utc",)), ("-1", ("utc",)))]
    df = spark.createDataFrame(rows, "t string, m array<string>")
    given = ", ".join(f"coalesce(get(m, {k}), '')" for k in range(5))
    mine = df.selectExpr("t", "m", f"datetime(t, {given}) AS d", f"strftime('%Y-%j %H', t, {given}) AS f", f"unixepoch(t, {given}) AS u").collect()
    for r in mine:
        marks = ", ?" * len(r.m)
        theirs = plain.execute(f"SELECT datetime(?{marks}), strftime('%Y-%j %H', ?{marks}), unixepoch(?{marks})", [r.t, *r.m] * 3).fetchone()
        assert (r.d, r.f, r.u) == theirs, (r.t, r.m)
    assert spark.sql("SELECT date_of('2024-05-05', '+1 day'), time_of('2024-05-05', '+61 minutes'), datetime('2024-05-05', NULL)").first() == ("2024-05-06", "01:01:00", None)


def test_overlap_join_against_plain_join(spark):
    rng = random.Random(4)
    base = dt.datetime(2024, 1, 1)

    def spans(n):
        out = []
        for k in range(n):
            start = base + dt.timedelta(seconds=rng.randrange(100_000))
            length = rng.choice([0, 1, 30, 600, 5_000, 90_000, 4_000_000, -50])
            out.append((rng.choice(["a", "b", None]), k, start if rng.random() < 0.97 else None, start + dt.timedelta(seconds=length)))
        return out

    lefts, rights = spans(150), spans(170)
    left = spark.createDataFrame(lefts, "who string, l int, ls timestamp, le timestamp")
    right = spark.createDataFrame(rights, "who string, r int, rs timestamp, re timestamp")
    expected = sorted((a[1], b[1]) for a in lefts for b in rights if a[0] and a[0] == b[0] and a[2] and b[2] and a[2] < b[3] and b[2] < a[3])
    for seconds in (None, 0.5, 60, 1e6):
        found = overlap_join(left, right, ["who"], ("ls", "le"), ("rs", "re"), seconds)
        assert sorted((r.l, r.r) for r in found.collect()) == expected
    assert found.columns == ["who", "l", "ls", "le", "r", "rs", "re"]
    assert overlap_join(left.limit(0), right.limit(0), ["who"], ("ls", "le"), ("rs", "re")).collect() == []


@pytest.mark.parametrize("exclude", ["CURRENT ROW", "GROUP", "TIES"])
def test_frames_with_exclusions(spark, exclude):
    rng = random.Random(7)
    rows = [(k, rng.choice("xy"), rng.choice([None, 1, 2, 2, 3]), rng.choice([None, *range(9)])) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, k string, o int, v int")
    first, last = -(1 << 63), (1 << 63) - 1
    for start, end in [(-3, 2), (first, last), (first, 0), (0, last), (-4, -2), (1, 3), (first, 2)]:
        want = {}
        for key in "xy":
            part = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
            for i, r in enumerate(part):
                frame = [x for j, x in enumerate(part) if i + start <= j <= i + end]
                peer = lambda x: x[2] == r[2]
                out = {"CURRENT ROW": lambda x: x is r, "GROUP": peer, "TIES": lambda x: peer(x) and x is not r}[exclude]
                values = [x[3] for x in frame if not out(x) and x[3] is not None]
                want[r[0]] = (sum(values) if values else None, len(values), sum(values) / len(values) if values else None, min(values, default=None), max(values, default=None))
        found = df
        for how in ("sum", "count", "avg", "min", "max"):
            found = with_frame(found, how, how, "v", ["k"], ["o"], start, end, exclude, ["id"])
        assert {r["id"]: tuple(r)[4:] for r in found.collect()} == want, (start, end)
    if exclude != "CURRENT ROW":
        with pytest.raises(ValueError, match="unbounded"):
            with_frame(df, "m", "min", "v", ["k"], ["o"], first, -2, exclude, ["id"])


def test_deep_pages(spark):
    rows = [(n % 7 if n % 11 else None, f"t{n * 37 % 1000:03d}", n) for n in range(3000)]
    df = spark.createDataFrame(rows, "a int, t string, n int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for n in (0, 1, 150, 299, 300):
        found = deep_page(df, n, ["a", "t", "n"], size=10, sorted_rows=100)
        assert [tuple(r) for r in found.collect()] == ordered[n * 10 : n * 10 + 10]
    assert [r.n for r in deep_page(spark.range(500).withColumnRenamed("id", "n"), 40, ["n"], 10, 50).collect()] == list(range(400, 410))


def test_deep_page_sorts_few_rows(spark):
    df = spark.range(0, 600_000, numPartitions=4).withColumnRenamed("id", "line_no")
    found = deep_page(df, 5000, ["line_no"], sorted_rows=50_000)
    assert [r[0] for r in found.collect()] == list(range(500_000, 500_100))
    plan = found._jdf.queryExecution().executedPlan().toString()
    limits = [int(x) for x in __import__("re").findall(r"limit=(\d+)", plan)]
    assert limits and max(limits) < 50_200


def test_same_rows_end_the_search(spark):
    df = spark.createDataFrame([(1,)] * 300, "n int")
    assert deep_page(df, 2, ["n"], size=10, sorted_rows=20).count() == 10


def test_not_in_means_what_sql_means(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,)], "x int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for values in ([(2,), (9,)], [(2,), (None,)], [], [(None,)]):
            other = spark.createDataFrame(values, "y int")
            found = not_in(df, "x", other)
            expected = spark.sql("SELECT x FROM {df} WHERE x NOT IN (SELECT y FROM {other})", df=df, other=other)
            assert sorted(found.collect(), key=repr) == sorted(expected.collect(), key=repr)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_not_in_as_part_of_a_condition(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,), (2,)], "x int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for values in ([(2,), (9,), (2,)], [(2,), (None,)], [], [(None,)]):
            other = spark.createDataFrame(values, "y int")
            found = with_not_in(df, "x", other, "out")
            # Each of the three values that it can have, told by conditions; a NOT IN can't be selected.
            parts = [("true", "x NOT IN (SELECT y FROM {other})"), ("false", "x IN (SELECT y FROM {other})")]
            told = {how: spark.sql(f"SELECT x FROM {{df}} WHERE {text}", df=df, other=other).collect() for how, text in parts}
            for how, rows in told.items():
                assert sorted(found.filter(f"out = {how}").select("x").collect(), key=repr) == sorted(rows, key=repr)
            assert found.count() == 5
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Broadcast" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_not_in_under_or_is_no_nested_loop(spark, tmp_path):
    kinds = ["view", "click", "error", "signup", "purchase", "error"]
    rows = [(k, dt.datetime(2024, 1, 1, 0, 0, k), k % 3, kind, 1.5 * k, "{}") for k, kind in enumerate(kinds * 2)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for part, expected in ((events, {"GET": 4, "POST": 4}), (events.filter("event_type <> 'error'"), {"GET": 4, "POST": 4})):
        part.write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        found = queries()["sql_not_in_nulls"](spark, str(tmp_path))
        assert dict(found.collect()) == expected
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_export_runs_the_plan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(100).mapInArrow(look, "id long")
    assert export_csv(df, str(tmp_path / "out")) and seen.value == 100
    assert not export_csv(df.filter("id < 0"), str(tmp_path / "none")) and seen.value == 200
    assert results.PAGE_ROWS == 100
