"""Corpus queries: log files are written to the shared folder, then found, detected and loaded."""

from pyspark.sql import functions as F

from catalog import sources as src
from catalog.registry import log_table, query, table
from timberline.operators.detect import confidence_pct, detect_format
from timberline.plans import canned
from timberline.plans.load import load_logs
from timberline.session import scratch_path
from timberline.sources import stored
from timberline.sources.text_files import read_log_lines, read_utf16_lines, with_line_numbers
from timberline.sources.triage import list_files, triage

# ------------------------------------------------------------- detection

# What each line of a corpus file looks like. Buckets differ in their mixture:
# 0 nginx, 1 twelve syslog to eight nginx, 2 JSON with some journald keys,
# 3 journald, 4 mostly prose, 5 virtual hosts, 6 nothing but comments.
_KIND = """CASE
    WHEN event_id % 13 = 0 OR user_id % 7 = 6 THEN 'comment'
    WHEN user_id % 7 = 0 THEN 'nginx'
    WHEN user_id % 7 = 1 THEN CASE WHEN event_id % 20 < 12 THEN 'syslog' ELSE 'nginx' END
    WHEN user_id % 7 = 2 THEN CASE WHEN event_id % 20 < 9 THEN 'journald_json' ELSE 'json' END
    WHEN user_id % 7 = 3 THEN 'journald'
    WHEN user_id % 7 = 4 THEN CASE WHEN event_id % 20 < 6 THEN 'nginx' ELSE 'prose' END
    ELSE 'vhost' END"""
_FILE = "concat('user-', cast(user_id as string), '.log')"

_DETECTED = f"""
  WITH lines AS (SELECT {_FILE} AS file, event_id, {_KIND} AS kind FROM events),
  sample AS (SELECT * FROM lines WHERE kind <> 'comment'
             QUALIFY row_number() OVER (PARTITION BY file ORDER BY event_id) <= 20),
  counts AS (SELECT file, count(*) AS sampled,
                    count(*) FILTER (WHERE kind = 'nginx') AS nginx_access,
                    count(*) FILTER (WHERE kind IN ('nginx', 'vhost')) AS apache_access,
                    count(*) FILTER (WHERE kind = 'syslog') AS syslog,
                    count(*) FILTER (WHERE kind IN ('journald', 'journald_json')) AS journald,
                    count(*) FILTER (WHERE kind IN ('json', 'journald_json')) AS json
             FROM sample GROUP BY file),
  candidates AS (
    SELECT file, sampled, 'nginx_access' AS format, 5 AS priority, nginx_access AS matched FROM counts UNION ALL
    SELECT file, sampled, 'apache_access', 4, apache_access FROM counts UNION ALL
    SELECT file, sampled, 'syslog', 3, syslog FROM counts UNION ALL
    SELECT file, sampled, 'journald', 6, journald FROM counts UNION ALL
    SELECT file, sampled, 'json', 2, json FROM counts),
  best AS (SELECT *, matched / sampled AS share, matched / sampled * priority + matched / sampled AS score
           FROM candidates
           QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, matched DESC, priority DESC) = 1),
  detected AS (
    SELECT f.file, CASE WHEN share >= 0.5 THEN format ELSE 'generic' END AS format,
           CASE WHEN share >= 0.5 THEN score ELSE 0.0 END AS score,
           CASE WHEN share >= 0.5 THEN matched ELSE 0 END AS matched, coalesce(sampled, 0) AS sampled,
           CASE WHEN share >= 0.5 THEN share ELSE 0.0 END AS confidence
    FROM (SELECT DISTINCT file FROM lines) f LEFT JOIN best ON f.file = best.file)"""


def corpus_lines(spark, folder):
    """(file, block, line_no, raw): a file per user, blocks of a fixed number of event ids."""
    iso, local = src.ISO.format("ts"), src.LOCAL.format("ts")
    raw = F.expr(f"""CASE {_KIND}
        WHEN 'comment' THEN concat('  # event ', cast(event_id as string))
        WHEN 'nginx' THEN concat('10.0.0.1 - - [', {local}, ' +0000] "GET / HTTP/1.1" 200 ', cast(event_id as string))
        WHEN 'vhost' THEN concat('shop.example 10.0.0.1 - - [', {local}, ' +0000] "GET / HTTP/1.1" 200 -')
        WHEN 'syslog' THEN concat('<34>', {src.MONTH_NAME.format('ts')}, ' ', cast(day(ts) as string), ' ',
                                  {src.CLOCK.format('ts')}, ' host app: ', event_type)
        WHEN 'journald' THEN concat('MESSAGE=', event_type)
        WHEN 'journald_json' THEN concat('{{"PRIORITY":"6","MESSAGE":"', event_type, '"}}')
        WHEN 'json' THEN concat('{{"ts":"', {iso}, '","level":"info"}}')
        ELSE concat('then ', event_type, ' came by') END""")
    placed = log_table(spark, folder, "events").withColumns(
        {
            "file": F.expr(_FILE),
            "block": F.floor(F.col("event_id") / 4096).cast("bigint"),
            "line_no": F.col("event_id"),
        }
    )
    return src.written(placed, raw, "file", "block", "line_no")


def _detect(spark, folder):
    lines = corpus_lines(spark, folder)
    return detect_format(lines, lines.select("file").distinct())


@query(f"""{_DETECTED}
    SELECT *, cast(floor(confidence * 100 + 0.5) as int) AS confidence_pct FROM detected""")
def detect_corpus(spark, folder):
    return _detect(spark, folder).withColumn("confidence_pct", confidence_pct(F.col("confidence")))


def _quoted(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


_MENU = ", ".join(
    "(" + ", ".join(_quoted(v) for v in (name, n, c.label, c.sql, c.about)) + ")"
    for name in ("nginx_access", "apache_access", "syslog", "journald", "json", "generic")
    for n, c in enumerate(canned.suggested_queries(name), start=1)
)


@query(f"""{_DETECTED}
    SELECT file, format, n, label, sql, about
    FROM detected JOIN (VALUES {_MENU}) AS m(format, n, label, sql, about) USING (format)""")
def suggested_queries(spark, folder):
    return canned.suggestions_for(_detect(spark, folder))


# ----------------------------------------------------------- written files


def _write(lines, path: str, by: str, order: list[str]) -> str:
    """Text files in one folder per value of ``by``, each with its lines in order."""
    lines.sortWithinPartitions(by, *order).select("raw", by).write.partitionBy(by).text(path)
    return path


def _written_corpus(spark, folder):
    """The corpus as one file per user."""
    lines = corpus_lines(spark, folder).select("file", F.col("line_no").alias("event_id"), "raw").repartition("file")
    return _write(lines, scratch_path(spark, "corpus"), "file", ["event_id"])


_NAME = r"file=([^/]+)/"

# Tasks that a table of small splits is read in.
TASKS_PER_CORE = 4


@query(f"{_DETECTED} SELECT file, format, score, matched, sampled, confidence FROM detected")
def detect_in_many_splits(spark, folder):
    """The same files, small as they are, read in splits of a few lines."""
    path = _written_corpus(spark, folder)
    small = {"spark.sql.files.maxPartitionBytes": "4KB", "spark.sql.files.openCostInBytes": "512"}
    # A task takes many splits, in place of one; a block is a split as before.
    small["spark.sql.files.maxPartitionNum"] = str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    before = {name: spark.conf.get(name, None) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        found = load_logs(spark, path).detection
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return found.drop("confidence_pct").withColumn("file", F.regexp_extract("file", _NAME, 1))


@query(f"""
    SELECT file, 'syslog' AS format, count(*) FILTER (WHERE kind = 'syslog') AS row_count,
           count(*) FILTER (WHERE kind <> 'syslog') AS skipped_count, 0 AS confidence,
           CASE WHEN count(*) FILTER (WHERE kind = 'syslog') = 0 THEN 'no lines parsed' ELSE 'loaded' END AS status
    FROM (SELECT {_FILE} AS file, {_KIND} AS kind FROM events) GROUP BY file""")
def format_override(spark, folder):
    """Every file loaded as syslog, whatever it holds."""
    summary = load_logs(spark, _written_corpus(spark, folder), format="syslog").summary
    name = F.regexp_extract("file", _NAME, 1)
    return summary.select(name.alias("file"), "format", "row_count", "skipped_count", "confidence", "status")


def _written_documents(spark, folder, body):
    parts = F.posexplode(F.split("text", "\n")).alias("n", "line")
    lines = log_table(spark, folder, "documents").select("doc_id", "lang", parts).withColumn("raw", F.expr(body))
    return _write(lines, scratch_path(spark, "documents"), "lang", ["doc_id", "n"])


@query("""
    SELECT doc_id, count(*) AS lines, true AS in_order, sum(length(line))::bigint AS chars
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def line_numbers(spark, folder):
    """Each written line names its document and its place in it; line numbers must run along."""
    path = _written_documents(spark, folder, "concat(cast(doc_id as string), '|', cast(n as string), '|', line)")
    lines = with_line_numbers(read_log_lines(spark, path))
    part = F.split("raw", r"\|", 3)
    read = lines.select(
        "file",
        part[0].cast("bigint").alias("doc_id"),
        (F.col("line_no") - part[1].cast("bigint")).alias("start"),
        F.length(part[2]).alias("size"),
    )
    # A document may lie in one file only, in lines that follow each other.
    return read.groupBy("doc_id").agg(
        F.count("*").alias("lines"),
        ((F.min("start") == F.max("start")) & (F.min("file") == F.max("file"))).alias("in_order"),
        F.sum("size").alias("chars"),
    )


@query("""
    SELECT lang, sum(strlen(text) + 1 + CASE WHEN lang = 'de' THEN 1 ELSE 0 END)::bigint AS bytes,
           bool_and(lang <> 'de') AS is_text, 'utf-8' AS encoding
    FROM documents GROUP BY lang""")
def triage_text(spark, folder):
    """The documents of one language begin with a NUL and so are no text."""
    path = _written_documents(
        spark, folder, "concat(CASE WHEN lang = 'de' AND n = 0 THEN decode(X'00', 'UTF-8') ELSE '' END, line)"
    )
    lang = F.regexp_extract("file", "lang=([a-z]+)", 1)
    return triage(spark, path).groupBy(lang.alias("lang")).agg(
        F.sum("bytes").alias("bytes"), F.bool_and("is_text").alias("is_text"), F.max("encoding").alias("encoding")
    )


@query("SELECT lang, sum(strlen(text) + 1)::bigint AS bytes, 'ok' AS tier FROM documents GROUP BY lang")
def triage_size(spark, folder):
    path = _written_documents(spark, folder, "line")
    lang = F.regexp_extract("file", "lang=([a-z]+)", 1)
    return list_files(spark, path).groupBy(lang.alias("lang")).agg(
        F.sum("bytes").alias("bytes"), F.max("tier").alias("tier")
    )


@query("""
    WITH files AS (SELECT lang, sum(strlen(text) + 1)::bigint AS bytes FROM documents GROUP BY lang)
    SELECT lang, bytes, CASE WHEN bytes <= 50 * 2000 THEN 'ok' WHEN bytes <= 100 * 2000 THEN 'warn'
                             WHEN bytes <= 500 * 2000 THEN 'confirm' ELSE 'reject' END AS tier FROM files""")
def triage_size_low(spark, folder):
    """One file for each language, with limits that count in units of 2,000 bytes."""
    parts = F.posexplode(F.split("text", "\n")).alias("n", "raw")
    lines = table(spark, folder, "documents").select("doc_id", "lang", parts).repartition("lang")
    path = _write(lines, scratch_path(spark, "documents"), "lang", ["doc_id", "n"])
    return list_files(spark, path, 2000).select(F.regexp_extract("file", "lang=([a-z]+)", 1).alias("lang"), "bytes", "tier")


_LINES_OF_DOCUMENTS = """
    SELECT doc_id, count(*) AS lines, sum(length(line))::bigint AS chars
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id"""


@query(_LINES_OF_DOCUMENTS)
def utf16_lines(spark, folder):
    """The documents as UTF-16, read back in splits."""
    return _through_utf16(spark, folder, "UTF-16LE")


@query(_LINES_OF_DOCUMENTS)
def utf16be_lines(spark, folder):
    return _through_utf16(spark, folder, "UTF-16BE")


def _through_utf16(spark, folder, charset):
    parts = F.posexplode(F.split("text", "\n")).alias("n", "line")
    lines = log_table(spark, folder, "documents").select("doc_id", parts)
    raw = F.concat(F.col("doc_id").cast("string"), F.lit("|"), "line")
    path = scratch_path(spark, "utf16")
    (
        lines.sortWithinPartitions("doc_id", "n")
        .select(F.encode(raw, charset).cast("string").alias("value"))
        .write.option("encoding", charset).option("lineSep", "\n").text(path)
    )
    part = F.split("raw", r"\|", 2)
    read = read_utf16_lines(spark, path, charset.lower())
    return read.groupBy(part[0].cast("bigint").alias("doc_id")).agg(
        F.count("*").alias("lines"), F.sum(F.length(part[1])).alias("chars")
    )


_KINDS = "CASE event_id % 4 WHEN 0 THEN 'access' WHEN 1 THEN 'journal' WHEN 2 THEN 'app' ELSE 'plain' END"


@query(f"""
    SELECT CASE {_KINDS} WHEN 'access' THEN 'nginx_access' WHEN 'journal' THEN 'journald' WHEN 'app' THEN 'json'
                         ELSE 'generic' END AS format,
           count(*) AS row_count, 0::bigint AS skipped_count, 'loaded' AS status
    FROM events GROUP BY 1""")
def load_corpus(spark, folder):
    """A folder of four kinds of files, loaded at once; rows per detected format."""
    iso, local = src.ISO.format("ts"), src.LOCAL.format("ts")
    raw = F.expr(f"""CASE {_KINDS}
        WHEN 'access' THEN concat('10.0.0.1 - - [', {local}, ' +0000] "GET / HTTP/1.1" 200 ', cast(event_id as string))
        WHEN 'journal' THEN concat('PRIORITY=6', chr(10), 'MESSAGE=', event_type, chr(10), '  more', chr(10))
        WHEN 'app' THEN concat('{{"ts":"', {iso}, '","level":"info","id":', cast(event_id as string), '}}')
        ELSE concat('then ', event_type, ' came by') END""")
    lines = log_table(spark, folder, "events").select("event_id", F.expr(_KINDS).alias("kind"), raw.alias("raw"))
    path = _write(lines, scratch_path(spark, "corpus"), "kind", ["event_id"])
    loaded = load_logs(spark, path)
    return loaded.summary.groupBy("format", "status").agg(
        F.sum("row_count").alias("row_count"), F.sum("skipped_count").alias("skipped_count")
    )


_PAGE = "CASE event_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'shop' ELSE 'blog' END"
# Two days of the month of events.
_FROM, _TO = "2024-01-04T06", "2024-01-06T18"


@query(f"""
    SELECT cast(ts AS date) AS log_day, cast(CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS bigint) AS status, count(*) AS hits,
           min(event_id) AS first_event, max(event_id) AS last_event
    FROM events WHERE {src.ISO.format('ts')} >= '{_FROM}' AND {src.ISO.format('ts')} < '{_TO}' GROUP BY 1, 2""")
def stored_logs_by_day(spark, folder):
    """Access logs stored by day and time; the days outside the span asked for are not read."""
    raw = F.expr(f"""concat('10.0.0.1 - - [', {src.LOCAL.format('ts')}, ' +0000] "GET /', cast(event_id as string), ' HTTP/1.1" ',
                            CASE event_type WHEN 'error' THEN '500' ELSE '200' END, ' 1')""")
    lines = log_table(spark, folder, "events").select("event_id", F.expr(_PAGE).alias("site"), raw.alias("raw"))
    path = _write(lines, scratch_path(spark, "sites"), "site", ["event_id"])
    logs = load_logs(spark, path, store_at=scratch_path(spark, "stored")).df
    event = F.substring("path", 2, 20).cast("bigint")
    return stored.between(logs, _FROM, _TO).groupBy(stored.DAY, "status").agg(
        F.count("*").alias("hits"), F.min(event).alias("first_event"), F.max(event).alias("last_event")
    )


@query(f"""
    SELECT CASE {_KINDS} WHEN 'app' THEN 'json' ELSE 'nginx_access' END AS format, {_KINDS} AS kind,
           count(*) FILTER (WHERE {_KINDS} IN ('access', 'app')) AS row_count,
           count(*) FILTER (WHERE {_KINDS} NOT IN ('access', 'app')) AS skipped_count,
           CASE WHEN {_KINDS} IN ('access', 'app') THEN 100 ELSE 0 END AS confidence
    FROM events WHERE event_id % 4 <> 1 OR event_id % 8 = 1 GROUP BY ALL""")
def format_override_table(spark, folder):
    """A table of patterns gives most files of a folder a format; what no pattern fits is detected."""
    iso, local = src.ISO.format("ts"), src.LOCAL.format("ts")
    raw = F.expr(f"""CASE {_KINDS}
        WHEN 'access' THEN concat('10.0.0.1 - - [', {local}, ' +0000] "GET / HTTP/1.1" 200 ', cast(event_id as string))
        WHEN 'app' THEN concat('{{"ts":"', {iso}, '","id":', cast(event_id as string), '}}')
        ELSE concat('then ', event_type, ' came by') END""")
    events = log_table(spark, folder, "events").filter("event_id % 4 <> 1 OR event_id % 8 = 1")
    lines = events.select("event_id", F.expr(_KINDS).alias("kind"), raw.alias("raw"))
    path = _write(lines, scratch_path(spark, "fleet"), "kind", ["event_id"])
    # Two patterns fit the plain files, and the longer one decides.
    fleet = [("kind=p*/*", "syslog"), ("**/kind=plain/part-*", "nginx_access"), ("kind=journal/*", "nginx_access")]
    summary = load_logs(spark, path, format=spark.createDataFrame(fleet, "glob string, format string")).summary
    kind = F.regexp_extract("file", "kind=([a-z]+)", 1)
    return summary.groupBy("format", kind.alias("kind")).agg(
        F.sum("row_count").alias("row_count"), F.sum("skipped_count").alias("skipped_count"), F.min("confidence").alias("confidence")
    )
