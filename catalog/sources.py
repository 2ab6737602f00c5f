"""Structured rows behind the log lines.

Each text is a query that Spark and the checking engine both run on the same
table. ``logs`` in the check is made of it directly; in Spark its columns are
written into lines first and come back through a parser.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import log_table
from timberline.functions.once import with_once


def _two(expression: str) -> str:
    return f"lpad(cast({expression} as string), 2, '0')"


MONTH_NAME = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month({0}) as int) * 3 - 2, 3)"
CLOCK = "concat(" + ", ':', ".join([_two("hour({0})"), _two("minute({0})"), _two("second({0})")]) + ")"
DAY = "concat(cast(year({0}) as string), '-', " + _two("month({0})") + ", '-', " + _two("day({0})") + ")"
ISO = f"concat({DAY}, 'T', {CLOCK}, '.000Z')"
LOCAL = f"concat({_two('day({0})')}, '/', {MONTH_NAME}, '/', cast(year({{0}}) as string), ':', {CLOCK})"

ACCESS_ROWS = f"""
  SELECT event_id AS line_no,
         concat('10.0.', cast(cast(floor(user_id / 256) as bigint) as string), '.',
                cast(user_id % 256 as string)) AS remote_addr,
         CASE WHEN event_type = 'purchase' THEN concat('user', cast(user_id as string)) END AS remote_user,
         concat({LOCAL.format('ts')}, ' +0000') AS time_local,
         {ISO.format('ts')} AS timestamp,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
         concat('/', event_type, '/', cast(user_id as string)) AS path,
         'HTTP/1.1' AS protocol,
         cast(CASE event_type WHEN 'error' THEN 500 + event_id % 4 WHEN 'signup' THEN 201
                              WHEN 'click' THEN 304 ELSE 200 END as bigint) AS status,
         CASE WHEN event_type <> 'click' THEN cast(round(value * 100) as bigint) END AS body_bytes_sent,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN concat('https://shop.example/', event_type)
              END AS http_referer,
         CASE WHEN event_type <> 'signup' THEN concat('agent/', cast(user_id % 7 as string)) END AS http_user_agent
  FROM {{events}}"""

ACCESS_RAW = """concat(remote_addr, ' - ', coalesce(remote_user, '-'), ' [', time_local, '] "', method, ' ', path, ' ',
    protocol, '" ', cast(status as string), ' ', coalesce(cast(body_bytes_sent as string), '-'),
    CASE WHEN http_user_agent IS NULL THEN ''
         ELSE concat(' "', coalesce(http_referer, '-'), '" "', http_user_agent, '"') END)"""

# One access line per order line: the large table.
LINEITEM_ROWS = f"""
  SELECT concat('10.1.', cast(l_suppkey % 256 as string), '.', cast(l_linenumber as string)) AS remote_addr,
         concat({LOCAL.format('l_shipdate')}, ' +0000') AS time_local,
         {ISO.format('l_shipdate')} AS timestamp,
         concat('/part/', cast(l_partkey as string), '/order/', cast(l_orderkey as string)) AS path,
         cast(CASE l_returnflag WHEN 'A' THEN 404 WHEN 'R' THEN 500 ELSE 200 END as bigint) AS status,
         cast(round(l_extendedprice) as bigint) AS body_bytes_sent,
         concat('agent/', l_linestatus) AS http_user_agent
  FROM {{lineitem}}"""
LINEITEM_RAW = """concat(remote_addr, ' - - [', time_local, '] "GET ', path, ' HTTP/1.1" ', cast(status as string), ' ',
    cast(body_bytes_sent as string), ' "-" "', http_user_agent, '"')"""

SYSLOG_NOW = "2002-01-15 12:00:00"
_MINUTE = "cast(o_orderkey % 60 as int)"
SYSLOG_ROWS = f"""
  SELECT o_orderkey AS line_no,
         CASE WHEN o_orderstatus <> 'P'
              THEN cast((o_custkey % 24) * 8 + cast(substr(o_orderpriority, 1, 1) as bigint) as bigint) END AS priority,
         {MONTH_NAME.format('o_orderdate')} AS month_name,
         cast(day(o_orderdate) as int) AS day_no,
         cast(month(o_orderdate) as int) AS month_no,
         concat({_two('o_custkey % 24')}, ':', {_two(_MINUTE)}, ':07') AS clock,
         cast(o_custkey % 24 as int) AS hour_no,
         {_MINUTE} AS minute_no,
         concat('host', cast(o_custkey % 10 as string)) AS hostname,
         CASE WHEN o_custkey % 11 <> 0
              THEN CASE o_orderstatus WHEN 'O' THEN 'sshd' WHEN 'F' THEN 'cron' ELSE 'kernel' END END AS tag,
         CASE WHEN o_custkey % 11 <> 0 AND o_orderstatus = 'O' THEN o_orderkey % 5000 END AS pid,
         concat('order ', cast(o_orderkey as string), ' total ', cast(cast(floor(o_totalprice) as bigint) as string))
             AS message
  FROM {{orders}}"""

SYSLOG_RAW = """concat(
    CASE WHEN priority IS NULL THEN '' ELSE concat('<', cast(priority as string), '>') END,
    month_name, ' ', lpad(cast(day_no as string), 2, ' '), ' ', clock, ' ', hostname, ' ',
    CASE WHEN tag IS NULL THEN ''
         WHEN pid IS NULL THEN concat(tag, ': ')
         ELSE concat(tag, '[', cast(pid as string), ']: ') END,
    message)"""

JOURNAL_FILES, JOURNAL_STRIDE, JOURNAL_BLOCK = 8, 16, 5000
JOURNAL_ROWS = f"""
  SELECT event_id, event_id * {JOURNAL_STRIDE} AS line_no,
         concat('journal-', cast(event_id % {JOURNAL_FILES} as string)) AS file,
         ts,
         cast(CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 5 ELSE 6 END as bigint)
             AS priority,
         CASE WHEN event_type <> 'view' THEN concat(event_type, '.service') END AS unit,
         concat('node', cast(user_id % 13 as string)) AS hostname,
         concat('app', cast(user_id % 29 as string)) AS identifier,
         CASE WHEN event_type <> 'click' THEN user_id END AS pid,
         CASE WHEN event_type = 'error' THEN concat('failed request', chr(10), 'value=', cast(event_id as string),
                                                    chr(10), 'giving up')
              ELSE concat('handled ', event_type) END AS message
  FROM {{events}}"""

JSON_ROWS = f"""
  SELECT event_id AS line_no,
         {ISO.format('ts')} AS timestamp,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN NULL ELSE 'info' END
             AS level,
         concat(event_type, ' by ', cast(user_id as string)) AS message,
         user_id, event_id, event_type, value, props
  FROM {{events}}"""

LEVEL_CASE = """CASE
      WHEN lower({0}) LIKE '%fatal%' OR lower({0}) LIKE '%crit%' OR lower({0}) LIKE '%emergency%' THEN 'fatal'
      WHEN lower({0}) LIKE '%err%' OR lower({0}) LIKE '%fail%' OR lower({0}) LIKE '%exception%' THEN 'error'
      WHEN lower({0}) LIKE '%warn%' THEN 'warning'
      WHEN lower({0}) LIKE '%notice%' THEN 'notice'
      WHEN lower({0}) LIKE '%info%' THEN 'info'
      WHEN lower({0}) LIKE '%debug%' OR lower({0}) LIKE '%dbg%' THEN 'debug'
      WHEN lower({0}) LIKE '%trace%' OR lower({0}) LIKE '%verbose%' THEN 'trace'
      WHEN {0} LIKE '%[E]%' THEN 'error'
      WHEN {0} LIKE '%[W]%' THEN 'warning'
      ELSE 'info' END"""

# A word in front of each line, so that all levels occur.
DOCUMENT_WORD = """CASE doc_id % 12 WHEN 0 THEN 'FATAL ' WHEN 1 THEN 'Error: ' WHEN 2 THEN '[W] ' WHEN 3 THEN 'Notice ' WHEN 4 THEN 'debug '
      WHEN 5 THEN 'TRACE ' WHEN 6 THEN 'Warning ' WHEN 7 THEN '[E] ' WHEN 8 THEN 'Info ' ELSE '' END"""

# A document's lines are numbered in a range of their own.
DOCUMENT_STRIDE = 1_000_000


def rows(spark: SparkSession, folder: str, text: str, name: str) -> DataFrame:
    return spark.sql(text, **{name: log_table(spark, folder, name)})


def check(text: str, name: str) -> str:
    return text.replace("{" + name + "}", name)


def written(rows: DataFrame, raw: Column, *keep: str) -> DataFrame:
    """Rows as lines; the text is made once, as if it had been read."""
    keep = keep or tuple(name for name in ("line_no",) if name in rows.columns)
    return with_once(rows, "raw", raw).select(*keep, "raw")


def access_lines(spark: SparkSession, folder: str, raw: str = ACCESS_RAW) -> DataFrame:
    return written(rows(spark, folder, ACCESS_ROWS, "events"), F.expr(raw))


def syslog_lines(spark: SparkSession, folder: str) -> DataFrame:
    return written(rows(spark, folder, SYSLOG_ROWS, "orders"), F.expr(SYSLOG_RAW))


def journal_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Several lines per event: the keys, indented continuations, and a blank line between records."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("string")
    record = F.split(
        F.concat_ws(
            "\n",
            F.concat(F.lit("__REALTIME_TIMESTAMP="), micros),
            F.concat(F.lit("PRIORITY="), F.col("priority").cast("string")),
            F.concat(F.lit("_SYSTEMD_UNIT="), "unit"),
            F.concat(F.lit("_HOSTNAME="), "hostname"),
            F.concat(F.lit("SYSLOG_IDENTIFIER="), "identifier"),
            F.concat(F.lit("_PID="), F.col("pid").cast("string")),
            F.concat(F.lit("MESSAGE="), F.replace("message", F.lit("\n"), F.lit("\n   "))),
            F.lit(""),
        ),
        "\n",
    )
    lines = rows(spark, folder, JOURNAL_ROWS, "events").select("file", "line_no", F.posexplode(record).alias("n", "raw"))
    number = F.col("line_no") + F.col("n")
    block = F.floor(number / JOURNAL_BLOCK).cast("bigint")
    return lines.select("file", block.alias("block"), number.alias("line_no"), "raw")


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Objects with nested, mixed, missing, null, boolean, array and empty values."""

    def text(name):
        return F.concat(F.lit('"'), name, F.lit('"'))

    code = F.when(F.col("user_id") % 5 == 0, text(F.concat(F.lit("c"), F.col("user_id").cast("string")))).otherwise(
        F.col("user_id").cast("string")
    )
    ratio = F.when(F.col("event_id") % 3 == 0, F.lit("2")).otherwise(F.lit("0.5"))
    raw = F.concat(
        F.lit('{"ts":"'), "timestamp", F.lit('","level":'), F.coalesce(text(F.col("level")), F.lit("null")),
        F.lit(',"msg":"'), "message", F.lit('","user":{"id":'), F.col("user_id").cast("string"),
        F.lit(',"tags":["'), "event_type", F.lit('",'), F.col("user_id").cast("string"),
        F.lit(']},"value":'), F.col("value").cast("string"), F.lit(',"ok":'),
        F.when(F.col("event_type") == "error", "false").otherwise("true"),
        F.lit(',"code":'), code, F.lit(',"ratio":'), ratio, F.lit(',"none":null,"empty":{},"Props":'), "props",
        F.when(F.col("event_type") == "purchase", F.concat(F.lit(',"late-field":'), F.col("event_id").cast("string")))
        .otherwise(""),
        F.lit("}"),
    )
    return written(rows(spark, folder, JSON_ROWS, "events"), raw)


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document, its first word set by the document."""
    parts = F.posexplode(F.split("text", "\n")).alias("n", "line")
    lines = log_table(spark, folder, "documents").select("doc_id", parts)
    numbered = lines.withColumn("line_no", F.col("doc_id") * DOCUMENT_STRIDE + F.col("n"))
    return written(numbered, F.concat(F.expr(DOCUMENT_WORD), "line"))


ACCESS_LOGS = f"logs AS (SELECT line_no, {ACCESS_RAW} AS raw, * EXCLUDE (line_no) FROM ({check(ACCESS_ROWS, 'events')}))"

_SYSLOG_STAMP = f"""SELECT *, make_timestamp(2002, month_no, 1, hour_no, minute_no, 7) + to_days(day_no - 1) AS this_year
  FROM ({check(SYSLOG_ROWS, 'orders')})"""
_SYSLOG_AT = f"""CASE WHEN this_year > TIMESTAMP '{SYSLOG_NOW}' + INTERVAL 1 DAY
    THEN make_timestamp(2001, month(this_year), 1, hour_no, minute_no, 7) + to_days(cast(day(this_year) as int) - 1)
    ELSE this_year END"""
SYSLOG_LOGS = f"""logs AS (
  SELECT line_no, {SYSLOG_RAW} AS raw, priority, priority // 8 AS facility, priority % 8 AS severity,
         strftime({_SYSLOG_AT}, '%Y-%m-%dT%H:%M:%S.000Z') AS timestamp, hostname, tag, pid, message
  FROM ({_SYSLOG_STAMP}))"""

_JOURNAL_RAW = """concat('__REALTIME_TIMESTAMP=', cast(epoch_us(ts) as string), chr(10), 'PRIORITY=', cast(priority as string),
    chr(10), CASE WHEN unit IS NULL THEN '' ELSE concat('_SYSTEMD_UNIT=', unit, chr(10)) END,
    '_HOSTNAME=', hostname, chr(10), 'SYSLOG_IDENTIFIER=', identifier, chr(10),
    CASE WHEN pid IS NULL THEN '' ELSE concat('_PID=', cast(pid as string), chr(10)) END,
    'MESSAGE=', replace(message, chr(10), concat(chr(10), '   ')))"""
JOURNAL_LOGS = f"""logs AS (
  SELECT file, line_no, {_JOURNAL_RAW} AS raw, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, priority, unit,
         hostname, identifier, pid, message
  FROM ({check(JOURNAL_ROWS, 'events')}))"""

JSON_LOGS = f"""logs AS (
  SELECT line_no, timestamp, level, message,
         CASE WHEN user_id % 5 = 0 THEN concat('c', cast(user_id as string)) ELSE cast(user_id as string) END AS code,
         '{{}}' AS empty,
         CASE WHEN event_type = 'purchase' THEN event_id END AS late_field,
         cast(NULL as string) AS none,
         cast(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END as bigint) AS ok,
         cast(json_extract_string(props, '$.k') as bigint) AS props_k,
         cast(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0.5 END as double) AS ratio,
         user_id,
         concat('["', event_type, '",', cast(user_id as string), ']') AS user_tags,
         value
  FROM ({check(JSON_ROWS, 'events')}))"""

_DOCUMENT_PARTS = """SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents"""
DOCUMENT_LOGS = f"""logs AS (
  SELECT line_no, raw, cast(NULL as string) AS timestamp, {LEVEL_CASE.format('raw')} AS level, raw AS message
  FROM (SELECT doc_id * {DOCUMENT_STRIDE} + n AS line_no, concat({DOCUMENT_WORD}, line) AS raw FROM ({_DOCUMENT_PARTS})))"""
