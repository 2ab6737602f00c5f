"""SQL over the ``logs`` table: joins, aggregates, windows, sets, expressions, changes.

Where both engines read the same text it is written once, with ``{logs}`` and
the other tables as placeholders. Busy clients are folded before any join.
"""

from pyspark.sql import functions as F

from catalog import sources as src
from catalog.parsing import access_logs
from catalog.registry import query, table
from timberline.functions.sql_names import register_functions
from timberline.functions.text import glob_match
from timberline.functions.times import event_time
from timberline.operators.dml import delete_where, insert_rows, update_where
from timberline.operators.frames import with_frame
from timberline.operators.membership import not_in, with_not_in
from timberline.operators.results import decode_binary_columns, deep_page, export_csv, page, recent_distinct
from timberline.operators.sketches import estimated, merged, sketched
from timberline.operators.time_joins import asof_join, overlap_join, range_join, with_previous
from timberline.session import scratch_path, write_once

_LOGS = src.ACCESS_LOGS
USER = "cast(split_part(path, '/', 3) as bigint)"


def _check_text(text: str) -> str:
    for name in ("logs", "customer", "nation", "region", "orders"):
        text = text.replace("{" + name + "}", name)
    text = text.strip()
    if text.startswith("WITH "):
        return f"WITH {_LOGS}, {text[5:]}"
    return f"WITH {_LOGS} {text}"


def _run(spark, folder, text):
    given = {n: table(spark, folder, n) for n in ("customer", "nation", "region", "orders") if "{" + n + "}" in text}
    if "{logs}" in text:
        given["logs"] = access_logs(spark, folder)
    return spark.sql(text, **given)


def sql(name: str, text: str, check: str | None = None):
    """Registers SQL for Spark; ``check`` is its spelling for the checking engine where that differs."""
    query(_check_text(check or text), name=name)(lambda spark, folder: _run(spark, folder, text))


# ------------------------------------------------------------------- joins

_PER_USER = f"""SELECT {USER} AS user_id, count(*) AS hits, cast(sum(body_bytes_sent) AS bigint) AS bytes
    FROM {{logs}} GROUP BY 1"""

sql(
    "sql_join_customers",
    f"""
    SELECT c.c_mktsegment AS segment, n.n_name AS nation, cast(sum(u.hits) AS bigint) AS hits,
           cast(sum(u.bytes) AS bigint) AS bytes
    FROM ({_PER_USER}) u JOIN {{customer}} c ON c.c_custkey = u.user_id JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
    GROUP BY 1, 2""",
)
sql(
    "sql_left_join_gaps",
    f"""
    SELECT c.c_custkey AS customer, coalesce(u.hits, 0) AS hits, u.bytes IS NULL AS silent
    FROM {{customer}} c LEFT JOIN ({_PER_USER}) u ON c.c_custkey = u.user_id""",
)
sql(
    "sql_right_join",
    f"""
    SELECT c.c_custkey AS customer, u.hits AS hits
    FROM ({_PER_USER}) u RIGHT JOIN {{customer}} c ON c.c_custkey = u.user_id AND u.hits > 50""",
)
sql(
    "sql_full_join",
    f"""
    SELECT coalesce(u.user_id, o.o_custkey) AS id, u.hits AS hits, o.orders AS orders
    FROM ({_PER_USER}) u FULL JOIN (SELECT o_custkey, count(*) AS orders FROM {{orders}} GROUP BY 1) o
      ON u.user_id = o.o_custkey""",
)
sql(
    "sql_using_join",
    f"""
    WITH a AS (SELECT {USER} AS user_id, count(*) AS errors FROM {{logs}} WHERE status >= 500 GROUP BY 1),
    b AS (SELECT {USER} AS user_id, count(*) AS posts FROM {{logs}} WHERE method = 'POST' GROUP BY 1)
    SELECT user_id, errors, posts FROM a JOIN b USING (user_id)""",
)
sql(
    "sql_natural_join",
    f"""
    WITH a AS (SELECT {USER} AS user_id, min(line_no) AS first_error FROM {{logs}} WHERE status >= 500 GROUP BY 1),
    b AS (SELECT {USER} AS user_id, max(line_no) AS last_view FROM {{logs}} WHERE path LIKE '/view/%' GROUP BY 1)
    SELECT user_id, first_error, last_view FROM a NATURAL JOIN b""",
)
sql(
    "sql_theta_join",
    """
    SELECT k.name AS class, cast(sum(s.n) AS bigint) AS hits
    FROM (SELECT status, count(*) AS n FROM {logs} GROUP BY status) s
    JOIN (VALUES ('ok', 200, 299), ('moved', 300, 399), ('failed', 400, 599)) AS k(name, low, high)
      ON s.status >= k.low AND s.status <= k.high
    GROUP BY k.name""",
)
sql(
    "sql_semi",
    f"""
    SELECT c_custkey AS customer, c_mktsegment AS segment FROM {{customer}} c
    WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT {USER} AS user_id FROM {{logs}} WHERE status >= 500) l
                  WHERE l.user_id = c.c_custkey)
      AND c_custkey IN (SELECT DISTINCT {USER} FROM {{logs}} WHERE method = 'POST')""",
)
sql(
    "sql_anti",
    f"""
    SELECT c_custkey AS customer FROM {{customer}} c
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {USER} AS user_id FROM {{logs}} WHERE status = 503) l
                      WHERE l.user_id = c.c_custkey)""",
)


@query(f"""
    WITH {_LOGS},
    spans AS (SELECT cast(timestamp AS timestamp) AS begins, min_ts FROM (
        SELECT min(timestamp) AS timestamp, min(timestamp) AS min_ts FROM logs WHERE status >= 500
        GROUP BY substr(timestamp, 1, 10)))
    SELECT min_ts AS incident, count(*) AS hits, count(*) FILTER (WHERE status >= 500) AS errors
    FROM logs JOIN spans ON cast(logs.timestamp AS timestamp) >= begins
                        AND cast(logs.timestamp AS timestamp) < begins + INTERVAL 2 HOUR
    GROUP BY 1""")
def sql_range_join(spark, folder):
    """Traffic in the two hours after the first error of each day."""
    logs = access_logs(spark, folder).select("timestamp", "status", event_time(F.col("timestamp")).alias("at"))
    first = logs.filter("status >= 500").groupBy(F.substring("timestamp", 1, 10).alias("day"))
    spans = first.agg(F.min("timestamp").alias("incident")).select(
        "incident",
        event_time(F.col("incident")).alias("begins"),
        (event_time(F.col("incident")) + F.expr("INTERVAL 2 HOURS")).alias("ends"),
    )
    inside = range_join(logs, spans, [], "at", "begins", "ends")
    return inside.groupBy("incident").agg(F.count("*").alias("hits"), F.count_if(F.col("status") >= 500).alias("errors"))


@query(f"""
    WITH {_LOGS}
    SELECT p.line_no, p.timestamp, (SELECT max(v.timestamp) FROM logs v WHERE v.remote_addr = p.remote_addr
            AND v.path LIKE '/view/%' AND v.timestamp <= p.timestamp) AS last_view
    FROM logs p WHERE p.path LIKE '/purchase/%'""")
def sql_asof(spark, folder):
    """Each purchase with the client's latest earlier view."""
    logs = access_logs(spark, folder).withColumn("at", event_time(F.col("timestamp")))
    bought = logs.filter("path LIKE '/purchase/%'").select("remote_addr", "line_no", "timestamp", "at")
    viewed = logs.filter("path LIKE '/view/%'").select(
        "remote_addr", F.col("timestamp").alias("last_view"), F.col("at").alias("viewed_at")
    )
    matched = asof_join(bought, viewed, ["remote_addr"], "at", "viewed_at")
    return matched.select("line_no", "timestamp", "last_view")


_GAPPY = """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, event_type,
    CASE WHEN event_id % 13 <> 0 THEN ts END AS ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events"""


def _gappy(spark, folder):
    return spark.sql(_GAPPY.replace("FROM events", "FROM {events}"), events=table(spark, folder, "events"))


@query(f"""
    WITH e AS ({_GAPPY})
    SELECT p.event_id, (SELECT max(v.ts) FROM e v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts) AS last_view
    FROM e p WHERE p.event_type <> 'view'""")
def sql_asof_nulls(spark, folder):
    """Keys and times may be NULL; they match nothing, and no row is lost."""
    events = _gappy(spark, folder)
    viewed = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("last_view"))
    others = events.filter("event_type <> 'view'").select("user_id", "event_id", "ts")
    return asof_join(others, viewed, ["user_id"], "ts", "last_view").select("event_id", "last_view")


@query(f"""
    WITH e AS ({_GAPPY})
    SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS before FROM e""")
def sql_previous_nulls(spark, folder):
    """The value of the row before, where keys, times and values may be NULL."""
    return with_previous(_gappy(spark, folder), ["user_id"], ["ts", "event_id"], "value", "before").select("event_id", "before")


# -------------------------------------------------------------- aggregates

sql(
    "sql_aggregates",
    """
    SELECT method, count(*) AS hits, count(body_bytes_sent) AS sized, cast(sum(body_bytes_sent) AS bigint) AS bytes,
           avg(body_bytes_sent) AS mean, min(body_bytes_sent) AS least, max(body_bytes_sent) AS most,
           count(DISTINCT remote_addr) AS clients, cast(sum(DISTINCT status) AS bigint) AS statuses,
           count(*) FILTER (WHERE status >= 500) AS errors
    FROM {logs} GROUP BY method""",
)
sql(
    "sql_global_aggregate",
    """
    SELECT count(*) AS total, min(timestamp) AS first_at, max(timestamp) AS last_at,
           coalesce(sum(cast(body_bytes_sent AS double)), 0.0) AS total_bytes,
           coalesce(sum(CASE WHEN status = 999 THEN cast(body_bytes_sent AS double) END), 0.0) AS none_bytes
    FROM {logs}""",
)
sql(
    "sql_having",
    f"SELECT {USER} AS user_id, count(*) AS hits FROM {{logs}} GROUP BY 1 HAVING count(*) > 40 AND max(status) >= 500",
)
sql(
    "sql_filter_agg",
    """
    SELECT remote_addr, count(*) FILTER (WHERE method = 'POST') AS posts,
           count(*) FILTER (WHERE status >= 500) AS errors, max(line_no) FILTER (WHERE status = 304) AS last_cached
    FROM {logs} GROUP BY remote_addr""",
)
sql(
    "sql_listagg",
    """
    SELECT method, listagg(status_text, ',') WITHIN GROUP (ORDER BY status_text) AS statuses
    FROM (SELECT DISTINCT method, cast(status AS string) AS status_text FROM {logs}) GROUP BY method""",
    """
    SELECT method, string_agg(status_text, ',' ORDER BY status_text) AS statuses
    FROM (SELECT DISTINCT method, cast(status AS string) AS status_text FROM {logs}) GROUP BY method""",
)
sql(
    "sql_value_of_largest",
    """
    SELECT remote_addr, max(body_bytes_sent) AS most, max_by(path, struct(body_bytes_sent, line_no)) AS path
    FROM {logs} WHERE body_bytes_sent IS NOT NULL GROUP BY remote_addr""",
    """
    SELECT remote_addr, max(body_bytes_sent) AS most, arg_max(path, body_bytes_sent * 1000000000::hugeint + line_no) AS path
    FROM {logs} WHERE body_bytes_sent IS NOT NULL GROUP BY remote_addr""",
)
sql(
    "sql_grouping_sets",
    """
    SELECT method, status, count(*) AS hits, cast(grouping(method) AS int) AS no_method,
           cast(grouping(status) AS int) AS no_status
    FROM {logs} GROUP BY GROUPING SETS ((method, status), (method), ())""",
)
sql("sql_cube", "SELECT method, status, count(*) AS hits FROM {logs} GROUP BY CUBE (method, status)")
sql(
    "sql_rollup",
    """SELECT substr(timestamp, 1, 10) AS day, method, count(*) AS hits
    FROM {logs} GROUP BY ROLLUP (substr(timestamp, 1, 10), method)""",
)
sql(
    "sql_approximate",
    """
    SELECT method, abs(approx_count_distinct(remote_addr) - count(DISTINCT remote_addr))
                   <= 0.15 * count(DISTINCT remote_addr) AS clients_close,
           abs(approx_percentile(body_bytes_sent, 0.5, 1000) - percentile(body_bytes_sent, 0.5))
                   <= 0.01 * (max(body_bytes_sent) - min(body_bytes_sent)) AS median_close,
           count(DISTINCT remote_addr) AS clients, percentile(body_bytes_sent, 0.5) AS median
    FROM {logs} GROUP BY method""",
    """
    SELECT method, abs(approx_count_distinct(remote_addr) - count(DISTINCT remote_addr))
                   <= 0.25 * count(DISTINCT remote_addr) AS clients_close,
           abs(approx_quantile(body_bytes_sent, 0.5) - quantile_cont(body_bytes_sent, 0.5))
                   <= 0.05 * (max(body_bytes_sent) - min(body_bytes_sent)) AS median_close,
           count(DISTINCT remote_addr) AS clients, quantile_cont(body_bytes_sent, 0.5) AS median
    FROM {logs} GROUP BY method""",
)

# ----------------------------------------------------------------- windows

sql(
    "sql_hourly_rank",
    """
    SELECT hour, path, hits, place FROM (
      SELECT hour, path, hits, cast(row_number() OVER (PARTITION BY hour ORDER BY hits DESC, path) AS bigint) AS place
      FROM (SELECT substr(timestamp, 1, 13) AS hour, path, count(*) AS hits FROM {logs} GROUP BY 1, 2) h) r
    WHERE place <= 3""",
)
sql(
    "sql_ranking_windows",
    """
    SELECT method, day, hits,
           cast(row_number() OVER (PARTITION BY method ORDER BY hits DESC, day) AS bigint) AS row_no,
           cast(rank() OVER (PARTITION BY method ORDER BY hits DESC) AS bigint) AS rank_no,
           cast(dense_rank() OVER (PARTITION BY method ORDER BY hits DESC) AS bigint) AS dense_no,
           percent_rank() OVER (PARTITION BY method ORDER BY hits DESC) AS percent_no,
           cume_dist() OVER (PARTITION BY method ORDER BY hits DESC) AS share_no,
           cast(ntile(4) OVER (PARTITION BY method ORDER BY hits DESC, day) AS bigint) AS quarter_no
    FROM (SELECT method, substr(timestamp, 1, 10) AS day, count(*) AS hits FROM {logs} GROUP BY 1, 2) d""",
)
sql(
    "sql_offset_windows",
    """
    SELECT method, day, hits, lag(hits) OVER w AS before, lead(hits, 2) OVER w AS two_later,
           first_value(hits) OVER w AS first_hits,
           last_value(hits) OVER (PARTITION BY method ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
               AS last_hits,
           nth_value(hits, 2) OVER (PARTITION BY method ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
               AS second_hits
    FROM (SELECT method, substr(timestamp, 1, 10) AS day, count(*) AS hits FROM {logs} GROUP BY 1, 2) d
    WINDOW w AS (PARTITION BY method ORDER BY day)""",
)
sql(
    "sql_moving_count",
    """
    SELECT method, hour_no, hits,
           cast(sum(hits) OVER (PARTITION BY method ORDER BY hour_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bigint)
               AS last_three_rows,
           cast(sum(hits) OVER (PARTITION BY method ORDER BY hour_no RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS bigint)
               AS last_six_hours
    FROM (SELECT method, cast(substr(timestamp, 9, 2) AS int) * 24 + cast(substr(timestamp, 12, 2) AS int) AS hour_no,
                 count(*) AS hits FROM {logs} GROUP BY 1, 2) h""",
)

# Frames of whole groups of equal values are RANGE frames over their dense rank.
sql(
    "sql_groups_frame",
    """
    SELECT status, place, hits, cast(sum(hits) OVER (ORDER BY place RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS bigint) AS two_groups
    FROM (SELECT status, hits, dense_rank() OVER (ORDER BY hits DESC) AS place
          FROM (SELECT status, count(*) AS hits FROM {logs} GROUP BY 1) c) r""",
    """
    SELECT status, dense_rank() OVER (ORDER BY hits DESC) AS place, hits,
           cast(sum(hits) OVER (ORDER BY hits DESC GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS bigint) AS two_groups
    FROM (SELECT status, count(*) AS hits FROM {logs} GROUP BY 1) c""",
)


@query(f"""
    WITH {_LOGS},
    gaps AS (SELECT remote_addr, epoch(cast(timestamp AS timestamp)) - epoch(lag(cast(timestamp AS timestamp))
                 OVER (PARTITION BY remote_addr ORDER BY timestamp, line_no)) AS gap FROM logs)
    SELECT remote_addr, count(*) AS hits, count(*) FILTER (WHERE gap IS NULL OR gap > 21600) AS sessions,
           cast(max(gap) AS bigint) AS longest_gap
    FROM gaps GROUP BY remote_addr""")
def sql_lag_gap_sessions(spark, folder):
    """Visits per client: a new one begins after six quiet hours."""
    logs = access_logs(spark, folder).select("remote_addr", "line_no", event_time(F.col("timestamp")).alias("at"))
    before = with_previous(logs, ["remote_addr"], ["at", "line_no"], "at", "previous")
    gap = F.unix_seconds("at") - F.unix_seconds("previous")
    return before.groupBy("remote_addr").agg(
        F.count("*").alias("hits"),
        F.count_if(gap.isNull() | (gap > 21600)).alias("sessions"),
        F.max(gap).alias("longest_gap"),
    )


# ------------------------------------------------------- sets, subqueries

# Each side is folded first: a set operation joins its sides before it removes duplicates.
_POSTED = "SELECT DISTINCT remote_addr FROM {logs} WHERE method = 'POST' AND status = 201"
_FAILED = "SELECT DISTINCT remote_addr FROM {logs} WHERE status = 503"
sql(
    "sql_union_all",
    """
    SELECT remote_addr, count(*) AS n FROM (
      SELECT remote_addr FROM {logs} WHERE method = 'POST' AND status = 201 UNION ALL
      SELECT remote_addr FROM {logs} WHERE status = 503) u
    GROUP BY 1""",
)
sql("sql_union", f"{_POSTED} UNION {_FAILED}")
sql("sql_intersect", f"{_POSTED} INTERSECT {_FAILED}")
sql("sql_except", f"{_POSTED} EXCEPT {_FAILED}")
sql(
    "sql_cte",
    f"""
    WITH per_user AS ({_PER_USER}), busy AS (SELECT * FROM per_user WHERE hits >= 60)
    SELECT count(*) AS busy_users, cast(sum(hits) AS bigint) AS busy_hits, max(bytes) AS most_bytes FROM busy""",
)
sql(
    "sql_recursive_cte",
    """
    WITH RECURSIVE clock(hour) AS (SELECT 0 UNION ALL SELECT hour + 1 FROM clock WHERE hour < 23),
    counted AS (SELECT cast(substr(timestamp, 12, 2) AS int) AS hour, count(*) AS errors
                FROM {logs} WHERE status = 503 GROUP BY 1)
    SELECT clock.hour AS hour, coalesce(counted.errors, 0) AS errors
    FROM clock LEFT JOIN counted ON clock.hour = counted.hour""",
    """
    SELECT hour, coalesce(errors, 0) AS errors FROM (SELECT cast(range AS int) AS hour FROM range(24))
    LEFT JOIN (SELECT cast(substr(timestamp, 12, 2) AS int) AS hour, count(*) AS errors
               FROM {logs} WHERE status = 503 GROUP BY 1) USING (hour)""",
)
sql(
    "sql_subqueries",
    f"""
    SELECT c_custkey AS customer, (SELECT max(body_bytes_sent) FROM {{logs}}) AS most,
           (SELECT count(*) FROM {{logs}} l WHERE {USER} = c.c_custkey AND l.status >= 500) AS errors
    FROM {{customer}} c WHERE c_acctbal > (SELECT avg(a.c_acctbal) FROM {{customer}} a WHERE a.c_nationkey = c.c_nationkey)""",
)
sql(
    "sql_values",
    """
    SELECT v.status AS status, v.meaning AS meaning, coalesce(l.hits, 0) AS hits
    FROM (VALUES (200, 'ok'), (201, 'created'), (404, 'missing')) AS v(status, meaning)
    LEFT JOIN (SELECT status, count(*) AS hits FROM {logs} GROUP BY status) l ON l.status = v.status""",
)

# ------------------------------------------------------------- expressions

sql(
    "sql_conditions",
    """
    SELECT line_no, CASE WHEN status >= 500 THEN 'bad' WHEN status >= 300 THEN 'moved' ELSE 'good' END AS verdict,
           coalesce(remote_user, 'anonymous') AS who, nullif(method, 'GET') AS unusual, ifnull(http_referer, '') AS via,
           if(status = 200, 1, 0) AS plain, remote_user IS NOT DISTINCT FROM http_referer AS same,
           status NOT IN (200, 304) AND NOT body_bytes_sent BETWEEN 100 AND 2000 AS odd
    FROM {logs}""",
)
sql(
    "sql_strings",
    """
    SELECT line_no, upper(method) AS up, lower(http_user_agent) AS low, length(path) AS size, substr(path, 2, 4) AS head,
           instr(path, '/') AS slash_at, replace(path, '/', '>') AS moved, trim(concat('  ', method, ' ')) AS trimmed,
           trim(LEADING '/' FROM path) AS no_slash, trim(TRAILING '1' FROM protocol) AS cut, method || ' ' || path AS joined,
           hex(method) AS codes, chr(65) AS letter, ascii(path) AS code
    FROM {logs}""",
    """
    SELECT line_no, upper(method) AS up, lower(http_user_agent) AS low, length(path) AS size, substr(path, 2, 4) AS head,
           instr(path, '/') AS slash_at, replace(path, '/', '>') AS moved, trim(concat('  ', method, ' ')) AS trimmed,
           ltrim(path, '/') AS no_slash, rtrim(protocol, '1') AS cut, method || ' ' || path AS joined,
           hex(method) AS codes, chr(65) AS letter, ascii(path) AS code
    FROM {logs}""",
)
sql(
    "sql_numbers",
    """
    SELECT line_no, abs(300 - status) AS off, round(body_bytes_sent / cast(7 AS double), 2) AS weeks, status % 100 AS rest,
           status div 100 AS class, try_divide(body_bytes_sent, status - 200) AS ratio
    FROM {logs}""",
    """
    SELECT line_no, abs(300 - status) AS off, round(body_bytes_sent / cast(7 AS double), 2) AS weeks, status % 100 AS rest,
           status // 100 AS class,
           CASE WHEN status <> 200 THEN body_bytes_sent / (status - 200) END AS ratio
    FROM {logs}""",
)
sql(
    "sql_dates",
    """
    SELECT date_format(hour_start, 'yyyy-MM-dd HH:mm') AS hour, weekday, epoch, hits FROM (
      SELECT date_trunc('HOUR', to_timestamp(timestamp)) AS hour_start, dayofweek(to_timestamp(timestamp)) - 1 AS weekday,
             unix_timestamp(date_trunc('HOUR', to_timestamp(timestamp))) AS epoch, count(*) AS hits
      FROM {logs} GROUP BY 1, 2, 3) h""",
    """
    SELECT strftime(hour_at, '%Y-%m-%d %H:%M') AS hour, cast(dayofweek(hour_at) AS int) AS weekday, cast(epoch(hour_at) AS bigint) AS epoch,
           count(*) AS hits
    FROM (SELECT date_trunc('hour', cast(timestamp AS timestamp)) AS hour_at FROM {logs}) GROUP BY 1, 2, 3""",
)
sql(
    "sql_casts",
    """
    SELECT line_no, cast(status AS string) AS status_text, cast(cast(status AS string) AS double) AS status_real,
           try_cast(path AS int) AS no_number, try_cast(substr(remote_addr, 1, 2) AS int) AS net
    FROM {logs}""",
)
sql(
    "sql_like",
    """
    SELECT line_no, path ILIKE '%ERROR%' AS mentions, path LIKE '/view/1_' AS one_of_ten, path LIKE '%/_%' AS below
    FROM {logs}""",
)
sql(
    "sql_regexp",
    "SELECT line_no, path FROM {logs} WHERE path RLIKE '^/(error|view)/[0-9]*5$'",
    "SELECT line_no, path FROM {logs} WHERE regexp_matches(path, '^/(error|view)/[0-9]*5$')",
)


@query(f"""
    WITH {_LOGS}
    SELECT strftime(cast(timestamp AS timestamp), '%Y-%m-%dT%H:00') AS hour, cast(dayofweek(cast(timestamp AS timestamp)) AS varchar) AS weekday,
           CASE WHEN status >= 500 THEN 1 ELSE 0 END + 1 AS verdict,
           min(cast(cast(epoch(cast(timestamp AS timestamp)) AS bigint) AS varchar)) AS first_second,
           min(strftime(cast(timestamp AS timestamp), '%Y-%m-%d %H:%M:%S')) AS first_at, count(*) AS hits,
           count(*) FILTER (WHERE line_no % 3 = 0) AS valid, count(*) FILTER (WHERE line_no % 2 = 0) AS objects
    FROM logs WHERE path GLOB '/[ev]*' AND NOT path GLOB '/*[5-9]' GROUP BY 1, 2, 3""")
def sql_sqlite_names(spark, folder):
    """Functions under their SQLite names."""
    register_functions(spark)
    text = """
        SELECT strftime('%Y-%m-%dT%H:00', timestamp) AS hour, strftime('%w', timestamp) AS weekday,
               if(status >= 500, 1, 0) + 1 AS verdict, min(strftime('%s', timestamp)) AS first_second,
               min(datetime(timestamp)) AS first_at, count(*) AS hits,
               count_if(json_valid(if(line_no % 3 = 0, '[1, 2]', '[1] 2'))) AS valid,
               count_if(json_type(if(line_no % 2 = 0, '{{"a": 1}}', '7')) = 'object') AS objects
        FROM {logs} WHERE glob('/[ev]*', path) AND glob('/*[^5-9]', path) GROUP BY 1, 2, 3"""
    return spark.sql(text, logs=access_logs(spark, folder))


sql(
    "sql_printf_typeof",
    """
    SELECT line_no, printf('%05d:%s', status, method) AS padded, lower(typeof(status)) AS kind, ascii(method) AS first_code,
           concat("'", replace(path, "'", "''"), "'") AS quoted
    FROM {logs}""",
    """
    SELECT line_no, printf('%05d:%s', status, method) AS padded, lower(typeof(status)) AS kind, ascii(method) AS first_code,
           concat(chr(39), replace(path, chr(39), concat(chr(39), chr(39))), chr(39)) AS quoted
    FROM {logs}""",
)


@query(_check_text("""
    SELECT method, count(*) AS hits FROM {logs}
    WHERE status NOT IN (SELECT max(body_bytes_sent) FROM {logs} GROUP BY status)
       OR status NOT IN (SELECT status FROM {logs} WHERE status >= 500) GROUP BY 1"""))
def sql_not_in_nulls(spark, folder):
    """Lines of one method and status are one row before they are held against the values."""
    logs = write_once(access_logs(spark, folder).select("method", "status", "body_bytes_sent"), "logs")
    folded = logs.groupBy("method", "status").agg(F.count("*").alias("hits"))
    folded = with_not_in(folded, "status", logs.groupBy("status").agg(F.max("body_bytes_sent")).drop("status"), "_no_size")
    folded = with_not_in(folded, "status", logs.filter("status >= 500").select("status"), "_no_error")
    return folded.filter("_no_size OR _no_error").groupBy("method").agg(F.sum("hits").alias("hits"))


@query(f"WITH {_LOGS} SELECT line_no, path FROM logs WHERE path GLOB '/[cv]*/?[0-4]'")
def sql_glob(spark, folder):
    logs = access_logs(spark, folder)
    return logs.filter(glob_match(F.col("path"), "/[cv]*/?[0-4]")).select("line_no", "path")


@query(f"""
    WITH j AS ({src.check(src.JSON_ROWS, 'events')})
    SELECT line_no, cast(user_id AS string) AS user_id, event_type AS first_tag, 2::int AS tags, 'object' AS user_kind,
           CASE WHEN event_type = 'purchase' THEN cast(line_no AS string) END AS late
    FROM j""")
def sql_json(spark, folder):
    """JSON functions over the raw line."""
    lines = src.json_lines(spark, folder)
    text = """
        SELECT line_no, get_json_object(raw, '$.user.id') AS user_id, get_json_object(raw, '$.user.tags[0]') AS first_tag,
               json_array_length(get_json_object(raw, '$.user.tags')) AS tags,
               CASE WHEN startswith(schema_of_variant(try_variant_get(try_parse_json(raw), '$.user', 'variant')), 'OBJECT')
                    THEN 'object' END AS user_kind,
               get_json_object(raw, "$['late-field']") AS late
        FROM {lines}"""
    return spark.sql(text, lines=lines)


@query("""
    SELECT event_id AS line_no, n::int AS n, tag FROM (
      SELECT event_id, 0 AS n, event_type AS tag FROM events UNION ALL
      SELECT event_id, 1, cast(user_id AS string) FROM events)""")
def sql_json_each(spark, folder):
    """The elements of an array in the line, one row each."""
    text = """
        SELECT line_no, pos AS n, variant_get(value, '$', 'string') AS tag
        FROM {lines}, LATERAL variant_explode(try_variant_get(try_parse_json(raw), '$.user.tags', 'variant'))"""
    return spark.sql(text, lines=src.json_lines(spark, folder))


# ----------------------------------------------------------------- changes


@query(f"""
    WITH {_LOGS}
    SELECT line_no, CASE WHEN status = 304 THEN 200 ELSE status END AS status,
           CASE WHEN status = 304 THEN coalesce(body_bytes_sent, 0) ELSE body_bytes_sent END AS body_bytes_sent, path
    FROM logs WHERE remote_user IS NULL OR remote_user NOT LIKE 'user1%'
    UNION ALL SELECT line_no + 1000000000, 599, NULL, path FROM logs WHERE status = 503""")
def dml_delete_update(spark, folder):
    """Delete, update and insert in turn; a condition that is NULL deletes nothing."""
    logs = access_logs(spark, folder).select("line_no", "status", "body_bytes_sent", "path", "remote_user")
    kept = delete_where(logs, F.col("remote_user").like("user1%")).drop("remote_user")
    changed = update_where(
        kept,
        F.col("status") == 304,
        {"status": F.lit(200), "body_bytes_sent": F.coalesce("body_bytes_sent", F.lit(0))},
    )
    copies = logs.filter("status = 503").select(
        (F.col("line_no") + 1_000_000_000).alias("line_no"), F.lit(599).cast("bigint").alias("status"), "path"
    )
    return insert_rows(changed, copies)


# ----------------------------------------------------------------- results


@query(f"WITH {_LOGS} SELECT * FROM logs ORDER BY line_no LIMIT 100 OFFSET 300")
def page_3(spark, folder):
    return page(access_logs(spark, folder), 3, ["line_no"])


@query(f"WITH {_LOGS} SELECT path, max(line_no) AS line_no FROM logs GROUP BY path ORDER BY line_no DESC, path LIMIT 10")
def recent_distinct_paths(spark, folder):
    return recent_distinct(access_logs(spark, folder), "path", "line_no")


@query(f"""
    WITH {_LOGS}
    SELECT method, remote_addr, line_no, cast(rank AS int) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY method ORDER BY line_no DESC, remote_addr) AS rank
      FROM (SELECT method, remote_addr, max(line_no) AS line_no FROM logs GROUP BY 1, 2)) WHERE rank <= 10""")
def recent_distinct_clients(spark, folder):
    return recent_distinct(access_logs(spark, folder), "remote_addr", "line_no", per="method")


@query("""
    SELECT conv_id, turn, concat(role, chr(65533)) AS speaker, text FROM conversations""")
def decode_binary(spark, folder):
    turns = table(spark, folder, "conversations")
    role = F.concat(F.col("role").cast("binary"), F.unhex(F.lit("FF")))
    return decode_binary_columns(turns.select("conv_id", "turn", role.alias("speaker"), F.col("text").cast("binary")))


@query("""
    SELECT conv_id, turn, CASE WHEN turn > 0 THEN concat('  "', role, '", ') END AS note, text FROM conversations""")
def export_csv_round_trip(spark, folder):
    """Quotes, commas, line breaks, outer spaces and NULLs through a CSV file and back."""
    turns = table(spark, folder, "conversations")
    note = F.when(F.col("turn") > 0, F.concat(F.lit('  "'), "role", F.lit('", ')))
    rows = turns.select("conv_id", "turn", note.alias("note"), "text")
    path = scratch_path(spark, "csv")
    export_csv(rows, path)
    return spark.read.csv(
        path, schema=rows.schema, header=True, escape='"', multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


_SPAN_SQL = """
    SELECT a.o_orderkey AS first_order, b.o_orderkey AS second_order, a.o_custkey AS customer
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
     AND a.o_orderdate < b.o_orderdate + to_days(cast(b.o_orderkey % 41 AS int)) AND b.o_orderdate < a.o_orderdate + to_days(cast(a.o_orderkey % 41 AS int))"""


@query(_SPAN_SQL)
def sql_overlap_join(spark, folder):
    """Orders of a customer that were open at the same time, each for some days."""
    orders = table(spark, folder, "orders")

    def open_for(side):
        opened = F.col("o_orderdate").cast("timestamp")
        days = (F.col("o_orderkey") % 41).cast("int")
        closed = F.timestamp_add("DAY", days, opened)
        return orders.select("o_custkey", F.col("o_orderkey").alias(f"{side}_order"), opened.alias(f"{side}_from"), closed.alias(f"{side}_to"))

    pairs = overlap_join(open_for("first"), open_for("second"), ["o_custkey"], ("first_from", "first_to"), ("second_from", "second_to"))
    return pairs.filter("first_order < second_order").select("first_order", "second_order", F.col("o_custkey").alias("customer"))


_HOURLY = f"""SELECT method, cast(substr(timestamp, 9, 2) AS int) * 24 + cast(substr(timestamp, 12, 2) AS int) AS hour_no, count(*) AS hits
    FROM logs GROUP BY 1, 2"""


@query(f"""
    WITH {_LOGS}, h AS ({_HOURLY}), c AS (SELECT *, hits % 7 AS class FROM h)
    SELECT method, hour_no, hits, class,
           cast(sum(hits) OVER (PARTITION BY method ORDER BY hour_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS bigint) AS around,
           max(hits) OVER (PARTITION BY method ORDER BY hour_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS best_around,
           cast(sum(hits) OVER (PARTITION BY method ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS bigint) AS other_classes,
           min(hits) OVER (PARTITION BY method ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS least_of_others,
           count(hits) OVER (PARTITION BY method ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS without_ties,
           max(hits) OVER (PARTITION BY method ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS best_without_ties
    FROM c""")
def sql_exclude_frames(spark, folder):
    logs = access_logs(spark, folder)
    hourly = spark.sql(_HOURLY.replace("FROM logs", "FROM {logs}"), logs=logs).withColumn("class", F.expr("hits % 7"))
    first, last = -(1 << 63), (1 << 63) - 1
    for name, how, order, start, end, exclude in [
        ("around", "sum", "hour_no", -3, 3, "CURRENT ROW"),
        ("best_around", "max", "hour_no", -3, 3, "CURRENT ROW"),
        ("other_classes", "sum", "class", first, last, "GROUP"),
        ("least_of_others", "min", "class", first, last, "GROUP"),
        ("without_ties", "count", "class", first, last, "TIES"),
        ("best_without_ties", "max", "class", first, last, "TIES"),
    ]:
        hourly = with_frame(hourly, name, how, "hits", ["method"], [order], start, end, exclude, ["hour_no"])
    return hourly


@query("""
    SELECT c_custkey AS customer, c_acctbal AS balance FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)""")
def sql_not_in_large(spark, folder):
    """Customers without a dear finished order; the values shuffle, however many they are."""
    values = table(spark, folder, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_custkey")
    customers = not_in(table(spark, folder, "customer"), "c_custkey", values)
    return customers.select(F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance"))


@query(f"WITH {_LOGS} SELECT * FROM logs ORDER BY path, line_no LIMIT 100 OFFSET (SELECT (count(*) // 200) * 100 FROM logs)")
def page_in_the_middle(spark, folder):
    """The page half way through all lines by path, found by counting ranges."""
    logs = write_once(access_logs(spark, folder), "logs")
    return deep_page(logs, logs.count() // 200, ["path", "line_no"], sorted_rows=1000)


_MOVED = [
    ("next_month", "datetime", "'+1 month'"),
    ("month_end", "date_of", "'start of month', '+1 month', '-1 day'"),
    ("monday", "date_of", "'weekday 1'"),
    ("later", "datetime", "'+36 hours', '-90 minutes', '+1.5 days'"),
    ("year_start", "datetime", "'start of year', '+10 days'"),
]


@query(f"""
    WITH {_LOGS}, t AS (SELECT line_no, cast(timestamp AS timestamp) AS t FROM logs)
    SELECT line_no,
           strftime(date_trunc('month', date_trunc('month', t) + INTERVAL 1 MONTH) + to_days(cast(day(t) - 1 AS int)) + (t - date_trunc('day', t)), '%Y-%m-%d %H:%M:%S') AS next_month,
           strftime(date_trunc('month', t) + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS month_end,
           strftime(t + to_days(cast((8 - dayofweek(t)) % 7 AS int)), '%Y-%m-%d') AS monday,
           strftime(t + INTERVAL 36 HOUR - INTERVAL 90 MINUTE + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS later,
           strftime(date_trunc('year', t) + INTERVAL 10 DAY, '%Y-%m-%d %H:%M:%S') AS year_start
    FROM t""")
def sql_date_modifiers(spark, folder):
    register_functions(spark)
    made = ", ".join(f"{function}(timestamp, {modifiers}) AS {name}" for name, function, modifiers in _MOVED)
    return spark.sql(f"SELECT line_no, {made} FROM {{logs}}", logs=access_logs(spark, folder))


@query(f"""
    WITH {_LOGS}
    SELECT substr(timestamp, 1, 10) AS day, count(*) AS n, count(DISTINCT remote_addr) AS clients, true AS clients_close, true AS median_close
    FROM logs GROUP BY 1""")
def sql_sketch_rollup(spark, folder):
    """Sketches of each hour, kept, and merged to days; the errors are held against exact counts."""
    logs = access_logs(spark, folder).select(F.substring("timestamp", 1, 13).alias("hour"), "remote_addr", "body_bytes_sent")
    hours = write_once(sketched(logs, ["hour"], "remote_addr", "body_bytes_sent"), "sketches")
    day = F.substring("hour", 1, 10).alias("day")
    days = estimated(merged(hours.withColumn("day", day), ["day"]), ["day"], [0.5])
    value = F.col("body_bytes_sent")
    exact = logs.groupBy(day).agg(
        F.count_distinct("remote_addr").alias("clients"), F.percentile(value, F.lit(0.45)).alias("low"), F.percentile(value, F.lit(0.55)).alias("high")
    )
    close = F.abs(F.col("distinct_estimate") - F.col("clients")) <= 0.08 * F.col("clients") + 1
    return days.join(exact, "day").select("day", "n", "clients", close.alias("clients_close"), F.col("q_50").between(F.col("low"), F.col("high")).alias("median_close"))
