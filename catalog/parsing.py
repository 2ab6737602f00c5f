"""Line formats: parsed logs and their ready-made analyses."""

from pyspark.sql import functions as F

from catalog import sources as src
from catalog.registry import log_table, query, table
from timberline.functions.keys import sanitize_key
from timberline.functions.levels import level_rank
from timberline.functions.text import lenient_int
from timberline.functions.times import epoch_millis, iso_text
from timberline.operators.access import parse_apache, parse_nginx, split_request
from timberline.operators.generic import parse_generic
from timberline.operators.journald import assemble_journald, parse_journald
from timberline.operators.json_lines import (
    flatten_json,
    infer_json_schema,
    parse_json,
)
from timberline.operators.results import table_info
from timberline.operators.summary import load_summary
from timberline.operators.syslog import parse_syslog
from timberline.plans import canned


def access_logs(spark, folder):
    return parse_nginx(src.access_lines(spark, folder))


def lineitem_logs(spark, folder):
    rows = src.rows(spark, folder, src.LINEITEM_ROWS, "lineitem")
    return parse_nginx(src.written(rows, F.expr(src.LINEITEM_RAW)))


def syslog_logs(spark, folder):
    return parse_syslog(src.syslog_lines(spark, folder), F.to_timestamp(F.lit(src.SYSLOG_NOW + "Z")))


def journald_logs(spark, folder):
    return parse_journald(assemble_journald(src.journal_lines(spark, folder)))


def json_logs(spark, folder):
    return parse_json(src.json_lines(spark, folder)).drop("raw")


def generic_logs(spark, folder):
    return parse_generic(src.document_lines(spark, folder), F.to_timestamp(F.lit(src.SYSLOG_NOW + "Z")))


# Several files whose line numbers repeat, made of the rows of one.
_FILE = "concat('f', cast(line_no % 7 AS string)) AS file"
_FILES = f"logs_of_files AS (SELECT * REPLACE (line_no // 7 AS line_no), {_FILE} FROM logs)"
_FILES_AGAIN = f"logs_of_files AS (SELECT * REPLACE (line_no // 7 AS line_no, {_FILE}) FROM logs)"


def _of_files(logs):
    name = F.concat(F.lit("f"), (F.col("line_no") % 7).cast("string"))
    return logs.withColumns({"file": name, "line_no": F.floor(F.col("line_no") / 7).cast("bigint")})


def _canned(prefix, source, logs_sql, queries):
    for name, item in queries.items():
        one = item.sql.replace(" file DESC,", "").replace(" file,", "")
        query(f"WITH {logs_sql} {one}", name=f"{prefix}_{name}")(
            lambda spark, folder, item=item: canned.run(item, source(spark, folder))
        )
        if one != item.sql:
            files = _FILES_AGAIN if prefix == "journald" else _FILES
            text = f"WITH {logs_sql}, {files} {item.sql}".replace(item.sql, item.sql.replace("FROM logs", "FROM logs_of_files"))
            query(text, name=f"{prefix}_{name}_of_files")(
                lambda spark, folder, item=item: canned.run(item, _of_files(source(spark, folder)))
            )


_canned(
    "access",
    access_logs,
    src.ACCESS_LOGS,
    {
        "status_counts": canned.ACCESS[0],
        "top_ips": canned.ACCESS[1],
        "server_errors": canned.ACCESS[2],
        "methods": canned.ACCESS[3],
        "largest": canned.ACCESS[4],
        "default_rows": canned.DEFAULT,
        "help_status": canned.HELP[0],
        "help_errors": canned.HELP[1],
        "top_paths": canned.HELP[2],
    },
)
_canned(
    "syslog",
    syslog_logs,
    src.SYSLOG_LOGS,
    {
        "by_host": canned.SYSLOG[0],
        "high_severity": canned.SYSLOG[1],
        "by_tag": canned.SYSLOG[2],
        "recent": canned.SYSLOG[3],
        "priority_counts": canned.SYSLOG[4],
    },
)
_canned(
    "journald",
    journald_logs,
    src.JOURNAL_LOGS,
    {
        "by_unit": canned.JOURNALD[0],
        "high_priority": canned.JOURNALD[1],
        "by_identifier": canned.JOURNALD[2],
        "recent": canned.JOURNALD[3],
        "by_hostname": canned.JOURNALD[4],
    },
)
_canned(
    "json",
    json_logs,
    src.JSON_LOGS,
    {
        "by_level": canned.JSON_BY_LEVEL,
        "first_rows": canned.JSON_FIRST,
        "errors_recent": canned.JSON_ERRORS,
        "recent": canned.JSON_RECENT,
        "row_count": canned.JSON_COUNT,
    },
)
_canned(
    "generic",
    generic_logs,
    src.DOCUMENT_LOGS,
    {
        "first_rows": canned.GENERIC[0],
        "search_error": canned.GENERIC[1],
        "line_count": canned.GENERIC[2],
        "recent": canned.GENERIC[3],
        "levels": canned.GENERIC[4],
    },
)


# ------------------------------------------------------------------ access


@query(f"WITH {src.ACCESS_LOGS} SELECT * FROM logs")
def access_parse(spark, folder):
    return access_logs(spark, folder)


# The clock of each line stands in an offset of its own, from -12:00 to +12:30.
_MINUTES_EAST = "cast((user_id % 25 - 12) * 60 + CASE WHEN event_id % 2 = 0 THEN 30 ELSE 0 END as int)"


@query(f"""
    SELECT event_id AS line_no,
           strftime(date_trunc('second', ts) - to_minutes({_MINUTES_EAST}), '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp
    FROM events""")
def access_timestamp_offsets(spark, folder):
    minutes = F.expr(_MINUTES_EAST)
    size = F.abs(minutes)
    zone = F.concat(
        F.when(minutes < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )
    raw = F.concat(
        F.lit("h - - ["), F.expr(src.LOCAL.format("ts")), F.lit(" "), zone, F.lit('] "GET / HTTP/1.1" 200 1')
    )
    lines = src.written(log_table(spark, folder, "events").withColumn("line_no", F.col("event_id")), raw)
    return parse_nginx(lines).select("line_no", "timestamp")


_VHOST_RAW = f"concat(CASE WHEN line_no % 3 = 0 THEN 'shop.example ' ELSE '' END, {src.ACCESS_RAW})"


@query(f"WITH {src.ACCESS_LOGS} SELECT * EXCLUDE (raw) FROM logs")
def apache_vhost_parse(spark, folder):
    return parse_apache(src.access_lines(spark, folder, _VHOST_RAW)).drop("raw")


@query(f"""
    SELECT status, count(*) AS hits, cast(sum(body_bytes_sent) AS bigint) AS bytes
    FROM ({src.check(src.LINEITEM_ROWS, 'lineitem')}) GROUP BY status""")
def access_lineitem_status(spark, folder):
    return lineitem_logs(spark, folder).groupBy("status").agg(
        F.count("*").alias("hits"), F.sum("body_bytes_sent").alias("bytes")
    )


@query(f"""
    SELECT substr(timestamp, 1, 7) AS month, http_user_agent, count(*) AS hits, count(DISTINCT remote_addr) AS clients,
           max(length(path)) AS longest_path
    FROM ({src.check(src.LINEITEM_ROWS, 'lineitem')}) GROUP BY 1, 2""")
def access_lineitem_months(spark, folder):
    logs = lineitem_logs(spark, folder)
    return logs.groupBy(F.substring("timestamp", 1, 7).alias("month"), "http_user_agent").agg(
        F.count("*").alias("hits"),
        F.countDistinct("remote_addr").alias("clients"),
        F.max(F.length("path")).cast("bigint").alias("longest_path"),
    )


_SPOILED_RAW = f"CASE WHEN line_no % 50 = 0 THEN concat('garbage ', path) ELSE {src.ACCESS_RAW} END"


@query("""
    SELECT concat('file-', cast(event_id % 5 as string)) AS file, 'nginx_access' AS format,
           sum(CASE WHEN event_id % 50 <> 0 THEN 1 ELSE 0 END)::bigint AS row_count,
           sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END)::bigint AS skipped_count
    FROM events GROUP BY 1""")
def access_skipped_summary(spark, folder):
    lines = src.access_lines(spark, folder, _SPOILED_RAW)
    filed = lines.withColumn("file", F.concat(F.lit("file-"), (F.col("line_no") % 5).cast("string")))
    return load_summary(filed, "nginx_access")


_REQUEST = """CASE page_id % 5 WHEN 0 THEN '-' WHEN 1 THEN url WHEN 2 THEN concat('GET ', url)
    WHEN 3 THEN concat('GET ', url, ' HTTP/1.1') ELSE concat('GET ', url, ' and more HTTP/1.1') END"""


@query("""
    SELECT page_id AS line_no, CASE WHEN page_id % 5 >= 2 THEN 'GET' END AS method,
           CASE page_id % 5 WHEN 0 THEN NULL WHEN 4 THEN concat(url, ' and more') ELSE url END AS path,
           CASE WHEN page_id % 5 >= 3 THEN 'HTTP/1.1' END AS protocol
    FROM pages""")
def request_split(spark, folder):
    requests = table(spark, folder, "pages").select(F.col("page_id").alias("line_no"), F.expr(_REQUEST).alias("request"))
    return requests.select("line_no", *[c.alias(name) for name, c in split_request(F.col("request")).items()])


# ------------------------------------------------------------------ syslog


@query(f"WITH {src.SYSLOG_LOGS} SELECT * FROM logs")
def syslog_parse(spark, folder):
    return syslog_logs(spark, folder)


# ---------------------------------------------------------------- journald


@query(f"WITH {src.JOURNAL_LOGS} SELECT file, line_no, raw FROM logs")
def journald_assemble(spark, folder):
    return assemble_journald(src.journal_lines(spark, folder))


@query(f"WITH {src.JOURNAL_LOGS} SELECT * FROM logs")
def journald_parse(spark, folder):
    return journald_logs(spark, folder)


@query(f"WITH {src.JOURNAL_LOGS} SELECT * EXCLUDE (raw, file) FROM logs")
def journald_json_parse(spark, folder):
    rows = src.rows(spark, folder, src.JOURNAL_ROWS, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    record = F.to_json(
        F.struct(
            micros.cast("string").alias("__REALTIME_TIMESTAMP"),
            F.col("priority").cast("string").alias("PRIORITY"),
            F.col("unit").alias("_SYSTEMD_UNIT"),
            F.col("hostname").alias("_HOSTNAME"),
            F.col("identifier").alias("SYSLOG_IDENTIFIER"),
            F.col("pid").alias("_PID"),
            F.col("message").alias("MESSAGE"),
        )
    )
    return parse_journald(src.written(rows, record)).drop("raw")


# -------------------------------------------------------------------- json


@query(f"WITH {src.JSON_LOGS} SELECT * FROM logs")
def json_parse(spark, folder):
    return json_logs(spark, folder)


_LONG = " UNION ALL ".join(
    f"SELECT line_no, '{key}' AS key, {value} AS value, '{kind}' AS kind FROM j WHERE {where}"
    for key, value, kind, where in [
        ("ts", "timestamp", "string", "true"),
        ("level", "level", "string", "level IS NOT NULL"),
        ("level", "cast(NULL as string)", "null", "level IS NULL"),
        ("msg", "message", "string", "true"),
        ("user_id", "cast(user_id as string)", "number", "true"),
        ("user_tags", "concat('[\"', event_type, '\",', cast(user_id as string), ']')", "array", "true"),
        ("value", "CASE WHEN value = floor(value) THEN cast(cast(value as bigint) as string) ELSE cast(value as string) END",
         "number", "true"),
        ("ok", "CASE WHEN event_type = 'error' THEN '0' ELSE '1' END", "boolean", "true"),
        ("code", "concat('c', cast(user_id as string))", "string", "user_id % 5 = 0"),
        ("code", "cast(user_id as string)", "number", "user_id % 5 <> 0"),
        ("ratio", "CASE WHEN event_id % 3 = 0 THEN '2' ELSE '0.5' END", "number", "true"),
        ("none", "cast(NULL as string)", "null", "true"),
        ("empty", "'{{}}'", "object", "true"),
        ("props_k", "json_extract_string(props, '$.k')", "number", "true"),
        ("late_field", "cast(event_id as string)", "number", "event_type = 'purchase'"),
    ]
).replace("{{}}", "{}")


@query(f"WITH j AS ({src.check(src.JSON_ROWS, 'events')}) {_LONG}")
def json_flatten(spark, folder):
    return flatten_json(src.json_lines(spark, folder))


_COLUMNS = [
    ("code", "TEXT"),
    ("empty", "TEXT"),
    ("late_field", "INTEGER"),
    ("none", "TEXT"),
    ("ok", "INTEGER"),
    ("props_k", "INTEGER"),
    ("ratio", "REAL"),
    ("user_id", "INTEGER"),
    ("user_tags", "TEXT"),
    ("value", "REAL"),
]


def _values(rows):
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)


@query(f"SELECT * FROM (VALUES {_values(_COLUMNS)}) AS t(name, type)")
def json_schema_infer(spark, folder):
    return infer_json_schema(src.json_lines(spark, folder))


_TABLE = [("line_no", "INTEGER"), ("raw", "TEXT"), ("timestamp", "TEXT"), ("level", "TEXT"), ("message", "TEXT")]


@query(f"SELECT name, type FROM (VALUES {_values(_TABLE + _COLUMNS)}) AS t(name, type)")
def json_table_info(spark, folder):
    logs = parse_json(src.json_lines(spark, folder))
    return canned.run(canned.JSON_COLUMNS, logs, table_info(logs))


# Three keys of its own in each record: wider than any table.
_WIDE = """concat('{"a', cast(event_id as string), '":', cast(event_id as string), ',"b', cast(event_id as string), '":1,"c',
    cast(event_id as string), '":2,"level":"', event_type, '"}')"""


@query(f"""
    SELECT event_type AS level, count(*) AS records, sum(length({_WIDE}))::bigint AS chars, sum(event_id)::bigint AS ids
    FROM events GROUP BY 1""")
def json_wide(spark, folder):
    """Records of more than 2,000 different keys, each kept whole."""
    lines = src.written(log_table(spark, folder, "events").withColumn("line_no", F.col("event_id")), F.expr(_WIDE), "line_no")
    logs = parse_json(lines).withColumn("kept", F.to_json("fields"))
    own = F.try_variant_get("fields", "$", "map<string,variant>")
    first = F.element_at(F.map_values(own), 1)
    return logs.groupBy("level").agg(
        F.count("*").alias("records"),
        F.sum(F.length("kept")).alias("chars"),
        F.sum(F.try_variant_get(first, "$", "bigint")).alias("ids"),
    )


@query(f"WITH {src.JSON_LOGS} SELECT line_no, late_field FROM logs WHERE late_field IS NOT NULL")
def json_late_column(spark, folder):
    return json_logs(spark, folder).filter("late_field IS NOT NULL").select("line_no", "late_field")


@query("""
    SELECT event_id AS line_no, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'first' END AS a_b,
           CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN cast(user_id as string) END AS level,
           CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS message
    FROM events""")
def json_promoted_and_shared_names(spark, folder):
    """Two keys of one name (the later one wins) and aliases that are passed over."""
    first, second = F.lit('"a-b":"first"'), F.lit('"a_b":"second"')
    even = F.col("event_id") % 2 == 0
    level = F.expr("""CASE event_id % 4
        WHEN 0 THEN '"level":true,"severity":"low"' WHEN 1 THEN '"Level":"high"'
        WHEN 2 THEN concat('"lvl":', cast(user_id as string)) ELSE '"level":null,"lvl":"unused","Level":null' END""")
    level = F.when(F.col("event_id") % 4 == 3, F.lit('"other":1')).otherwise(level)
    message = F.when(F.col("event_id") % 3 == 0, F.lit('"msg":{"text":"nested"}')).otherwise(
        F.concat(F.lit('"msg":"'), "event_type", F.lit('"'))
    )
    raw = F.concat_ws(
        "",
        F.lit("{"),
        F.when(even, F.concat(first, F.lit(","), second)).otherwise(F.concat(second, F.lit(","), first)),
        F.lit(","), level, F.lit(","), message, F.lit("}"),
    )
    lines = src.written(log_table(spark, folder, "events").withColumn("line_no", F.col("event_id")), raw)
    return parse_json(lines).select("line_no", "a_b", "level", "message")


# ----------------------------------------------------------------- generic


@query(f"WITH {src.DOCUMENT_LOGS} SELECT * FROM logs")
def generic_parse(spark, folder):
    return generic_logs(spark, folder)


@query(f"""
    WITH {src.DOCUMENT_LOGS}
    SELECT level, CASE level WHEN 'fatal' THEN 0 WHEN 'error' THEN 2 WHEN 'warning' THEN 3 WHEN 'notice' THEN 4
        WHEN 'info' THEN 5 WHEN 'debug' THEN 6 WHEN 'trace' THEN 7 END AS rank, count(*) AS lines
    FROM logs GROUP BY level""")
def generic_level_rank(spark, folder):
    counts = generic_logs(spark, folder).groupBy("level").agg(F.count("*").alias("lines"))
    return counts.select("level", level_rank(F.col("level")).alias("rank"), "lines").orderBy("rank")


@query(f"""
    SELECT conv_id, turn, {src.LEVEL_CASE.format('line')} AS level, line AS message
    FROM (SELECT conv_id, turn, concat('[', role, '] ', replace(text, chr(10), ' ')) AS line FROM conversations)""")
def generic_conversations(spark, folder):
    turns = table(spark, folder, "conversations")
    line = F.concat(F.lit("["), "role", F.lit("] "), F.replace("text", F.lit("\n"), F.lit(" ")))
    lines = turns.select(F.struct("conv_id", "turn").alias("line_no"), line.alias("raw"))
    return parse_generic(lines).select("line_no.conv_id", "line_no.turn", "level", "message")



@query("""
    SELECT event_id AS line_no, CASE event_id % 3
        WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END AS timestamp
    FROM events""")
def generic_epoch_times(spark, folder):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.floor(micros / 1_000_000).cast("string"))
        .when(F.col("event_id") % 3 == 1, F.floor(micros / 1000).cast("string"))
        .otherwise(micros.cast("string"))
    )
    lines = src.written(log_table(spark, folder, "events").withColumn("line_no", F.col("event_id")), text)
    return parse_generic(lines).select("line_no", "timestamp")


@query("""
    SELECT event_id AS line_no, CASE event_id % 7
        WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 1 THEN strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S.000Z')
        WHEN 2 THEN strftime(ts, '%Y-%m-%dT00:00:00.000Z') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z')
        WHEN 4 THEN strftime(ts, '2002-%m-%dT%H:%M:%S.000Z') WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') END AS timestamp
    FROM events""")
def generic_text_times(spark, folder):
    """ISO with fraction and zone, date alone, date and time, syslog style, mail style, and a time amid text."""
    clock, day = src.CLOCK.format("ts"), src.DAY.format("ts")
    millis = "lpad(cast(floor(timestampdiff(MICROSECOND, date_trunc('second', ts), ts) / 1000) as string), 3, '0')"
    month = src.MONTH_NAME.format("ts")
    raw = F.expr(f"""CASE event_id % 7
        WHEN 0 THEN concat({day}, 'T', {clock}, '.', {millis}, 'Z')
        WHEN 1 THEN concat({day}, 'T', {clock}, '+01:30')
        WHEN 2 THEN {day}
        WHEN 3 THEN concat(' ', replace({day}, '-', '/'), ' ', {clock})
        WHEN 4 THEN concat({month}, ' ', lpad(cast(day(ts) as string), 2, ' '), ' ', {clock}, ' host app: ', event_type)
        WHEN 5 THEN concat('Mon, ', cast(day(ts) as string), ' ', {month}, ' ', cast(year(ts) as string), ' ', {clock}, ' GMT')
        ELSE concat('at ', {day}, 'T', {clock}, ' user ', event_type) END""")
    lines = src.written(log_table(spark, folder, "events").withColumn("line_no", F.col("event_id")), raw)
    return parse_generic(lines, F.to_timestamp(F.lit(src.SYSLOG_NOW + "Z"))).select("line_no", "timestamp")


# ------------------------------------------------------------ field helpers


@query("""
    SELECT page_id, CASE WHEN name = '' THEN 'value' WHEN name BETWEEN '0' AND '9~' THEN concat('field_', name)
                         ELSE name END AS name
    FROM (SELECT page_id, lower(regexp_replace(regexp_replace(key, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name
          FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat(cast(page_id as string), url)
                                                 ELSE '-/:' END AS key FROM pages))""")
def key_sanitise(spark, folder):
    key = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat(cast(page_id as string), url) ELSE '-/:' END")
    return table(spark, folder, "pages").select("page_id", sanitize_key(key).alias("name"))


_NUMBER_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN concat(cast(o_custkey as string), 'abc')
    WHEN 3 THEN concat('  ', cast(o_custkey as string)) WHEN 4 THEN concat('-', cast(o_custkey as string), '.75')
    ELSE o_orderpriority END"""


@query("""
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN o_custkey WHEN 3 THEN o_custkey WHEN 4 THEN -o_custkey
        WHEN 5 THEN cast(substr(o_orderpriority, 1, 1) as bigint) END AS number
    FROM orders""")
def lenient_integers(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", lenient_int(F.expr(_NUMBER_TEXT)).alias("number"))


@query("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
        WHEN 1 THEN strftime(make_timestamp(user_id * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS timestamp
    FROM events""")
def epoch_digits(spark, folder):
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("string")
    text = (
        F.when(F.col("event_id") % 3 == 0, micros)
        .when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string"))
        .otherwise(F.concat(micros, F.lit("us")))
    )
    events = log_table(spark, folder, "events").select("event_id", epoch_millis(text).alias("ms"))
    return events.select("event_id", iso_text(F.col("ms")).alias("timestamp"))
