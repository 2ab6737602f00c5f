import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from timberline.operators.detect import detect_format
from timberline.operators.journald import assemble_journald
from timberline.plans import load
from timberline.plans.load import load_logs, path_pattern
from timberline.sources import stored, text_files, triage as triage_module
from timberline.sources.text_files import read_log_lines, read_utf16_lines, size_tier, with_line_numbers
from timberline.sources.triage import list_files, triage

NGINX = '172.20.7.{0} - - [19/May/2022:05:41:09 +0200] "PUT /item/{0}?v=2 HTTP/1.1" 200 {0}'


def numbered(spark, path):
    rows = with_line_numbers(read_log_lines(spark, str(path))).collect()
    return sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["raw"]) for r in rows)


def physical(name, text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return [(name, n, line) for n, line in enumerate(lines[:-1] if lines[-1] == "" else lines, 1)]


def random_text(seed, size, ends):
    choice = random.Random(seed)
    words = ["alpha", "beta", "", " ", "größe", "x" * 70]
    return "".join(choice.choice(words) + " " + str(i) + choice.choice(ends) for i in range(size))


@pytest.mark.parametrize("ends", [["\n"], ["\r\n"], ["\n", "\r\n", "\r", "\n\n"]])
def test_line_numbers_across_splits(spark, small_splits, tmp_path, ends):
    texts = {f"f{i}.log": random_text(i, 40 + 900 * i, ends) for i in range(4)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = numbered(spark, tmp_path)
    assert read_log_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 10
    assert got == sorted(row for name, text in texts.items() for row in physical(name, text))


def test_mark_blank_lines_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbfone\r\n\r\n \xff\xfe \nlast")
    bad = chr(0xFFFD)
    assert numbered(spark, tmp_path) == [("a.log", 1, "one"), ("a.log", 2, ""), ("a.log", 3, f" {bad}{bad} "), ("a.log", 4, "last")]


@pytest.mark.parametrize("encoding, codec, mark", [("utf-16le", "utf-16-le", b"\xff\xfe"), ("utf-16be", "utf-16-be", b"\xfe\xff")])
def test_utf16_across_splits(spark, small_splits, tmp_path, encoding, codec, mark):
    # These characters hold the bytes of a newline, in themselves and next to each other.
    odd = "".join(map(chr, [0x0A0A, 0x0A58, 0x0100, 0x4E00, 0x0A00 + 0x66, 0x2000, 0x010A]))
    choice = random.Random(7)
    text = "".join("".join(choice.choices("ab " + odd, k=choice.randrange(12))) + choice.choice(["\n", "\r\n", "\r"]) for _ in range(3000))
    (tmp_path / "w.log").write_bytes(mark + text.encode(codec))
    rows = read_utf16_lines(spark, str(tmp_path / "w.log"), encoding).collect()
    assert sorted((r["line_no"], r["raw"]) for r in rows) == [(n, line) for _, n, line in physical("w.log", text)]


def test_triage(spark, tmp_path):
    files = {
        "binary": b"\x41\x00\x42\x0a",
        "early": b"x" * 8190 + b"\n\x00",
        "late": b"x" * 8191 + b"\n\x00",
        "marked_early": b"\xef\xbb\xbf" + b"x" * 8187 + b"\n\x00",
        "marked_late": b"\xef\xbb\xbf" + b"x" * 8188 + b"\n\x00",
        "crlf_late": b"ab\r\n" * 2048 + b"\x00",
        "crlf_early": b"ab\r\n" * 2047 + b"abc\x00\n",
        "wide": b"\xff\xfea\x00\n\x00",
        "blank": b"\n \n",
        "plain": "größe\n".encode(),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["file"].rsplit("/", 1)[1]: r for r in triage(spark, str(tmp_path)).collect()}
    assert {n for n, r in rows.items() if not r["is_text"]} == {"binary", "early", "marked_early", "crlf_early"}
    assert {n for n, r in rows.items() if not r["has_lines"]} == {"blank"}
    assert rows["wide"]["encoding"] == "utf-16le" and rows["plain"]["bytes"] == 8 and rows["plain"]["tier"] == "ok"


def test_size_tiers(spark):
    mb = 1024 * 1024
    sizes = [(50 * mb, "ok"), (50 * mb + 1, "warn"), (100 * mb, "warn"), (100 * mb + 1, "confirm"), (500 * mb, "confirm"), (500 * mb + 1, "reject")]
    df = spark.createDataFrame(sizes, "size long, tier string")
    assert df.filter(size_tier(F.col("size")) != F.col("tier")).count() == 0


def test_journald_file_across_splits(spark, small_splits, tmp_path):
    records = [f"__REALTIME_TIMESTAMP=1700000000{i:06d}\nMESSAGE=m{i}\n" + "".join(f"  more {k}\n" for k in range(i % 40)) for i in range(400)]
    (tmp_path / "j.log").write_text("\n".join(records))
    rows = assemble_journald(with_line_numbers(read_log_lines(spark, str(tmp_path)))).orderBy("line_no").collect()
    assert [r["raw"] for r in rows] == [r.rstrip("\n") for r in records]


# ------------------------------------------------------------------ loading


def test_load_detects_and_counts(spark, tmp_path):
    (tmp_path / "web.log").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(NGINX.format(n) for n in (1, 2)).encode() + b"\r\n")
    loaded = load_logs(spark, str(tmp_path)).register()
    rows = spark.sql("SELECT remote_addr FROM logs ORDER BY line_no").collect()
    assert [r[0] for r in rows] == ["172.20.7.1", "172.20.7.2"]
    summary = loaded.summary.first()
    assert (summary["format"], summary["row_count"], summary["skipped_count"], summary["confidence"]) == ("nginx_access", 2, 0, 100)
    assert loaded.df.columns[:3] == ["file", "line_no", "raw"]


def test_load_skips_bad_json(spark, tmp_path):
    (tmp_path / "app.jsonl").write_text('{"user_id":1}\nnot-json\n{"user_id":2}\n')
    loaded = load_logs(spark, str(tmp_path)).register()
    assert loaded.summary.select("format", "row_count", "skipped_count").first() == ("json", 2, 1)
    assert [tuple(r) for r in spark.sql("SELECT line_no, user_id FROM logs ORDER BY 1").collect()] == [(1, 1), (3, 2)]
    names = spark.sql("SELECT name, type FROM logs_columns ORDER BY cid").collect()
    assert ("user_id", "INTEGER") in [tuple(r) for r in names]


def test_load_several_formats(spark, tmp_path):
    (tmp_path / "web.log").write_text("\n".join(NGINX.format(n) for n in range(9)))
    (tmp_path / "sys.log").write_text("<134>Jun  5 11:02:33 depot relay[90210]: ok\n<30>Jun  5 11:02:34 depot mount[1]: Ready\n")
    (tmp_path / "bin").write_bytes(b"a\x00b")
    (tmp_path / "wide.log").write_bytes(b"\xff\xfe" + "Oct 11 22:14:15 h a: b\n".encode("utf-16-le"))
    loaded = load_logs(spark, str(tmp_path)).register()
    assert sorted(loaded.tables) == ["nginx_access", "syslog"]
    counts = {r["file"].rsplit("/", 1)[1]: (r["status"], r["row_count"]) for r in loaded.summary.collect()}
    assert counts == {"web.log": ("loaded", 9), "sys.log": ("loaded", 2), "bin": ("binary", 0), "wide.log": ("loaded", 1)}
    tags = spark.sql("SELECT facility, severity, tag, pid FROM logs_syslog WHERE priority IS NOT NULL ORDER BY line_no").collect()
    assert [tuple(r) for r in tags] == [(16, 6, "relay", 90210), (3, 6, "mount", 1)]


def test_load_many_wide_files(spark, small_splits, tmp_path):
    for n in range(6):
        text = "".join(f"Oct 11 22:14:{i:02d} host{n} app: line {i}\n" for i in range(3 + 10 * n))
        (tmp_path / f"w{n}.log").write_bytes(b"\xfe\xff" + text.encode("utf-16-be"))
    loaded = load_logs(spark, str(tmp_path))
    assert list(loaded.tables) == ["syslog"]
    rows = loaded.df.groupBy("hostname").agg(F.count("*").alias("n"), F.max("line_no").alias("last")).collect()
    assert {r["hostname"]: (r["n"], r["last"]) for r in rows} == {f"host{n}": (3 + 10 * n, 3 + 10 * n) for n in range(6)}


def test_load_override(spark, tmp_path):
    (tmp_path / "web.log").write_text(NGINX.format(1))
    loaded = load_logs(spark, str(tmp_path), format="generic")
    assert loaded.df.select("message").first()[0] == NGINX.format(1)
    assert loaded.summary.first()["confidence"] == 0
    with pytest.raises(ValueError, match='Unknown log format "not_a_format"'):
        load_logs(spark, str(tmp_path), format="not_a_format")


def test_load_needs_lines(spark, tmp_path):
    (tmp_path / "blank.log").write_text("\n \n")
    with pytest.raises(ValueError, match="No log lines"):
        load_logs(spark, str(tmp_path))


def test_detection_does_not_depend_on_splits(spark, small_splits, tmp_path):
    # Comments fill the first splits, so the sample lies beyond them.
    (tmp_path / "long.log").write_text("# comment\n" * 3000 + "\n".join(NGINX.format(n) for n in range(30)))
    (tmp_path / "short.log").write_text("just\nprose\n")
    found = {r["file"].rsplit("/", 1)[1]: r["format"] for r in load_logs(spark, str(tmp_path)).detection.collect()}
    assert found == {"long.log": "nginx_access", "short.log": "generic"}
    whole = detect_format(read_log_lines(spark, str(tmp_path))).filter("format = 'nginx_access'").first()
    assert (whole["matched"], whole["sampled"], whole["confidence"]) == (20, 20, 1.0)


# ------------------------------------------------- splits that change in between

CHANGES = [
    {"spark.sql.files.maxPartitionBytes": "3KB", "spark.sql.files.openCostInBytes": "512"},
    {"spark.sql.files.maxPartitionBytes": "128MB", "spark.sql.files.openCostInBytes": "4MB"},
    {"spark.sql.files.minPartitionNum": "61"},
]


@pytest.fixture(params=range(len(CHANGES)))
def change_splits(spark, request):
    """Calls for other splits than those that a plan was built under."""
    names = {name for change in CHANGES for name in change}
    before = {name: spark.conf.get(name, None) for name in names}

    def change():
        for name, value in CHANGES[request.param].items():
            spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_no_line_is_lost_when_splits_change(spark, small_splits, change_splits, tmp_path):
    texts = {f"f{i}.log": random_text(i, 300 + 900 * i, ["\n", "\r\n"]) for i in range(3)}
    (tmp_path / "a").mkdir()
    for name, text in texts.items():
        (tmp_path / "a" / name).write_bytes(text.encode())
    wide = "".join(f"line {n}\n" for n in range(6000))
    (tmp_path / "w.log").write_bytes(b"\xff\xfe" + wide.encode("utf-16-le"))
    records = [f"MESSAGE=m{i}\nPRIORITY=6\n" + "".join(f"  more {k}\n" for k in range(i % 20)) for i in range(900)]
    (tmp_path / "j.log").write_text("\n".join(records))
    lines = with_line_numbers(read_log_lines(spark, str(tmp_path / "a")))
    utf16 = read_utf16_lines(spark, str(tmp_path / "w.log"), "utf-16le")
    journal = assemble_journald(read_log_lines(spark, str(tmp_path / "j.log")))
    change_splits()
    got = sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["raw"]) for r in lines.collect())
    assert got == sorted(row for name, text in texts.items() for row in physical(name, text))
    assert [(r["line_no"], r["raw"]) for r in utf16.orderBy("line_no").collect()] == [(n, x) for _, n, x in physical("w", wide)]
    assert [r["raw"] for r in journal.orderBy("line_no").collect()] == [r.rstrip("\n") for r in records]


def test_loading_while_splits_change(spark, small_splits, change_splits, tmp_path):
    (tmp_path / "web.log").write_text("".join(NGINX.format(n) + "\n" for n in range(2000)))
    loaded = load_logs(spark, str(tmp_path))
    change_splits()
    assert loaded.summary.first()["row_count"] == 2000
    assert [r[0] for r in loaded.df.select("line_no").orderBy("line_no").collect()] == list(range(1, 2001))


def test_mark_inside_a_utf16_file_is_text(spark, tmp_path):
    (tmp_path / "w.log").write_bytes("\ufeffa\n\ufeffb\n\n\ufeff".encode("utf-16-be"))
    rows = read_utf16_lines(spark, str(tmp_path / "w.log"), "utf-16be").orderBy("line_no").collect()
    assert [r["raw"] for r in rows] == ["a", "\ufeffb", "", "\ufeff"]


@pytest.mark.parametrize("size", ["400", "128MB"])
def test_small_files_in_many_splits(spark, small_splits, tmp_path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    text = "\n".join(["some prose here"] * 6 + [NGINX.format(n) for n in range(25)])
    (tmp_path / "mixed.log").write_text(text)
    row = load_logs(spark, str(tmp_path)).detection.first()
    assert (row["format"], row["sampled"], row["matched"]) == ("nginx_access", 20, 14)


def test_given_format_that_fits_nothing(spark, tmp_path):
    (tmp_path / "web.log").write_text("nothing like it\n")
    with pytest.raises(ValueError, match="No log lines could be parsed"):
        load_logs(spark, str(tmp_path), format="syslog")


def test_one_view_over_several_formats(spark, tmp_path):
    (tmp_path / "web.log").write_text("\n".join(NGINX.format(n) for n in range(5)))
    (tmp_path / "plain.log").write_text("one\ntwo\n")
    load_logs(spark, str(tmp_path)).register()
    rows = spark.sql("SELECT format, count(*), count(message), count(timestamp) FROM logs GROUP BY 1 ORDER BY 1").collect()
    assert [tuple(r) for r in rows] == [("generic", 2, 2, 0), ("nginx_access", 5, 0, 5)]
    assert spark.sql("SELECT count(*) FROM logs_columns").first()[0] == 6


def test_json_wider_than_a_table(spark, tmp_path):
    wide = {f"k{n}": n for n in range(50)} | {"ts": "2024-01-01T00:00:00Z", "msg": "hi"}
    (tmp_path / "wide.jsonl").write_text("\n".join([json.dumps(wide), '{"level":"warn","k7":"x"}', "bad"]))
    (tmp_path / "web.log").write_text(NGINX.format(1))
    loaded = load_logs(spark, str(tmp_path), max_columns=40)
    assert loaded.tables["nginx_access"].count() == 1
    table = loaded.tables["json"]
    assert table.columns == ["file", "line_no", "raw", "timestamp", "level", "message", "fields"]
    rows = table.selectExpr("timestamp", "level", "message", "variant_get(fields, '$.k7', 'string') AS k7").orderBy("line_no").collect()
    assert [tuple(r) for r in rows] == [("2024-01-01T00:00:00Z", None, "hi", "7"), (None, "warn", None, "x")]
    assert len(load_logs(spark, str(tmp_path), max_columns=50).tables["json"].columns) == 56


# ------------------------------------------------------- plans of the loader


def scans(df):
    """The leaves of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, found = plan.collectLeaves(), []
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        stage = leaf.getClass().getSimpleName().endswith("QueryStageExec")
        below = leaf.plan().collectLeaves() if stage else None
        found += [below.apply(i) for i in range(below.size())] if stage else [leaf]
    return found


def name_of(leaf):
    return leaf.nodeName().lower()


def test_text_is_read_once_to_look_and_once_for_each_format(spark, tmp_path, monkeypatch):
    reads = []
    original = text_files._scan

    def scan(spark, paths, **options):
        reads.append(sorted(p.rsplit("/", 1)[1] for p in ([paths] if isinstance(paths, str) else paths)))
        return original(spark, paths, **options)

    monkeypatch.setattr(text_files, "_scan", scan)
    monkeypatch.setattr(triage_module, "_scan", scan)
    (tmp_path / "web [1].log").write_text("\n".join(NGINX.format(n) for n in range(9)))
    (tmp_path / "sys+a%20.log").write_text("<30>Oct 11 22:14:16 box app: Started\n")
    (tmp_path / "app.jsonl").write_text('{"a":1}\n')
    loaded = load_logs(spark, str(tmp_path))
    everything = tmp_path.name
    # The look for NULs of suspect files is planned, and not run where there are none.
    assert reads == [[everything], [everything], ["app.jsonl"], [r"web \[1\].log"], ["sys+a%20.log"]]
    assert {r["status"] for r in loaded.summary.collect()} == {"loaded"}
    for df in (*loaded.tables.values(), loaded.summary, loaded.detection):
        assert not any("scan text" in name_of(leaf) for leaf in scans(df))


def test_lines_are_not_shuffled(spark, small_splits, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {n}\n" for n in range(5000)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = with_line_numbers(read_log_lines(spark, str(tmp_path)))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Scan text" not in plan
        assert lines.agg(F.max("line_no"), F.count_distinct("line_no")).first() == (5000, 5000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_blocks_are_joined(spark, small_splits, monkeypatch, tmp_path):
    """More fact rows than may be broadcast, and two files of one hash, go by way of a join."""
    text = random_text(3, 4000, ["\n", "\r\n"])
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_bytes(text.encode())
    expected = sorted(row for name in ("a.log", "b.log") for row in physical(name, text))
    for setting in ((text_files, "BROADCAST_BYTES", 0), (text_files.F, "xxhash64", lambda c: F.lit(1).cast("bigint"))):
        with monkeypatch.context() as m:
            m.setattr(*setting)
            lines = with_line_numbers(read_log_lines(spark, str(tmp_path)))
            assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["raw"]) for r in lines.collect()) == expected


def test_stored_logs_skip_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '10.0.0.1 - - [{:02d}/Mar/2023:{:02d}:{:02d}:00 +0000] "GET /p HTTP/1.1" {} 1'
    days = {d: [line.format(d, n // 60, n % 60, 200 + n % 2) for n in range(600)] for d in range(1, 8)}
    (tmp_path / "in" / "web.log").write_text("\n".join(x for d in days.values() for x in d) + "\nno access line\n")
    loaded = load_logs(spark, str(tmp_path / "in"), store_at=str(tmp_path / "kept"))
    assert loaded.summary.select("row_count", "skipped_count").first() == (4200, 1)
    everything = loaded.df
    files = lambda df: sum(leaf.metrics().apply("numFiles").value() for leaf in scans(df) if "parquet" in name_of(leaf))
    one_day = stored.between(everything, "2023-03-03T00", "2023-03-03T23")
    assert one_day.count() == 600 and one_day.agg(F.max("line_no") - F.min("line_no")).first()[0] == 599
    assert files(one_day) < files(everything)
    again = load_logs(spark, str(tmp_path / "in"), store_at=str(tmp_path / "kept"))
    assert again.df.count() == 8400 and again.summary.first()["row_count"] == 4200


def test_stored_tables_without_days(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1,"ts":"yesterday"}\n{"b":2}\n')
    table = load_logs(spark, str(tmp_path / "in"), store_at=str(tmp_path / "kept")).df
    assert sorted(map(tuple, table.select("a", "b", "log_day").collect()), key=repr) == [(1, None, None), (None, 2, None)]
    with pytest.raises(ValueError, match="log_day"):
        stored.store(table, str(tmp_path / "again"), "json")


@pytest.mark.parametrize(
    "glob,path,fits",
    [
        ("*.log", "file:/data/a.log", True),
        ("*.log", "file:///data/a.log.1", False),
        ("web/*.log", "hdfs://h/data/web/a.log", True),
        ("web/*.log", "hdfs://h/data/web/x/a.log", False),
        ("web/**.log", "hdfs://h/data/web/x/a.log", True),
        ("/data/*.log", "hdfs://h/data/a.log", True),
        ("/data/*.log", "hdfs://h/old/data/a.log", False),
        ("/data/*.log", "/data/a.log", True),
        ("a?c.[x]", "s3a://b/abc.[x]", True),
        ("a?c.[x]", "s3a://b/a/c.x", False),
    ],
)
def test_path_patterns(spark, glob, path, fits):
    assert spark.range(1).select(F.lit(path).rlike(path_pattern(glob))).first()[0] is fits


def test_overrides_by_path(spark, tmp_path):
    (tmp_path / "web").mkdir()
    for name in ("web/a.log", "web/b c.log", "d.log"):
        (tmp_path / name).write_text(NGINX.format(1) + "\n")
    loaded = load_logs(spark, str(tmp_path), format=[("web/*", "generic"), ("web/b c.*", "apache_access")])
    found = {r["file"].rsplit("/", 1)[1]: (r["format"], r["confidence"]) for r in loaded.summary.collect()}
    assert found == {"a.log": ("generic", 0), "b%20c.log": ("apache_access", 0), "d.log": ("nginx_access", 100)}
    with pytest.raises(ValueError, match="Unknown log format"):
        load_logs(spark, str(tmp_path), format=[("*", "csv")])
    table = spark.range(4).selectExpr("concat('x', id) AS glob", "'json' AS format")
    original, load.MOST_OVERRIDES = load.MOST_OVERRIDES, 3
    try:
        with pytest.raises(ValueError, match="more than 3"):
            load_logs(spark, str(tmp_path), format=table)
    finally:
        load.MOST_OVERRIDES = original


def most_tasks(spark, run):
    """The most tasks of one stage among those that ``run`` starts."""
    group, tracker = uuid.uuid4().hex, spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(k) for job in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(job).stageIds]
    return max(stage.numTasks for stage in stages if stage)


def test_tasks_of_many_splits(spark, tmp_path):
    """A task reads many of the small splits; the files are the same and have as many blocks."""
    kinds = ["view", "click", "error", "signup", "purchase"]
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), k % 7, kinds[k % 5], 1.5, "{}") for k in range(12000)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum"]
    before, found = [spark.conf.get(name, None) for name in names], []
    tasks = most_tasks(spark, lambda: found.extend(queries()["detect_in_many_splits"](spark, str(tmp_path)).collect()))
    # The lines have some 120 splits; the limit on tasks is a suggestion, and a stage may read two tables.
    assert tasks <= 10 * spark.sparkContext.defaultParallelism
    plain = queries()["detect_corpus"](spark, str(tmp_path)).drop("confidence_pct").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, plain)) and len(found) == 7
    assert [spark.conf.get(name, None) for name in names] == before


def test_listing_of_many_folders(spark, tmp_path):
    """Folders are listed by a bounded number of tasks, and the session's settings are as before."""
    most = text_files._LISTERS * spark.sparkContext.defaultParallelism
    for k in range(2 * most):
        (tmp_path / f"user={k}").mkdir()
        (tmp_path / f"user={k}" / "a.log").write_text(f"line {k}\n")
    names = ["spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize"]
    before = [spark.conf.get(name) for name in names]
    made = []
    assert most_tasks(spark, lambda: made.append(list_files(spark, str(tmp_path)))) <= most
    assert most_tasks(spark, lambda: made.append(read_log_lines(spark, str(tmp_path)))) <= most
    assert [m.count() for m in made] == [2 * most, 2 * most]
    assert [spark.conf.get(name) for name in names] == before
