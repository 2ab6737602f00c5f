"""Ready-made analyses per format, in Spark SQL over the view ``logs``.

Every limited or latest-first query ends in the file and the line number, so that
its rows do not depend on the order in which tasks finish. Line numbers run within a
file; a table without the column ``file`` holds the lines of one.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Canned:
    label: str
    sql: str
    about: str


DEFAULT = Canned("Default", "SELECT * FROM logs ORDER BY file, line_no LIMIT 100", "The first hundred rows.")

# Labels and queries.
ACCESS = [
    Canned(
        "Status breakdown",
        "SELECT status, COUNT(*) AS count FROM logs GROUP BY status ORDER BY count DESC, status",
        "Responses per status code.",
    ),
    Canned(
        "Top client IPs",
        "SELECT remote_addr, COUNT(*) AS hits FROM logs GROUP BY remote_addr ORDER BY hits DESC, remote_addr LIMIT 10",
        "Clients with the most requests.",
    ),
    Canned("Server errors", "SELECT * FROM logs WHERE status >= 500", "Requests answered with a 5xx status."),
    Canned("Methods", "SELECT method, COUNT(*) AS count FROM logs GROUP BY method", "Requests per HTTP method."),
    Canned(
        "Largest responses",
        "SELECT line_no, remote_addr, path, body_bytes_sent FROM logs WHERE body_bytes_sent IS NOT NULL "
        "ORDER BY body_bytes_sent DESC, file, line_no LIMIT 20",
        "Responses that sent the most bytes.",
    ),
]
SYSLOG = [
    Canned(
        "By hostname",
        "SELECT hostname, COUNT(*) AS count FROM logs GROUP BY hostname ORDER BY 2 DESC, 1",
        "Entries per host.",
    ),
    Canned("High severity", "SELECT * FROM logs WHERE severity <= 3", "Entries from emergency to error."),
    Canned("By tag", "SELECT tag, COUNT(*) AS count FROM logs GROUP BY tag ORDER BY 2 DESC, 1", "Entries per program."),
    Canned("Recent entries", "SELECT * FROM logs ORDER BY file DESC, line_no DESC LIMIT 50", "The last fifty entries."),
    Canned(
        "Priority counts",
        "SELECT priority, COUNT(*) AS count FROM logs GROUP BY priority ORDER BY priority",
        "Entries per priority value.",
    ),
]
JOURNALD = [
    Canned("By unit", "SELECT unit, COUNT(*) AS count FROM logs GROUP BY unit ORDER BY 2 DESC, 1", "Entries per unit."),
    Canned(
        "High priority",
        "SELECT * FROM logs WHERE priority <= 3 ORDER BY timestamp DESC, file DESC, line_no DESC LIMIT 50",
        "The latest entries from emergency to error.",
    ),
    Canned(
        "By identifier",
        "SELECT identifier, COUNT(*) AS count FROM logs GROUP BY identifier ORDER BY 2 DESC, 1 LIMIT 20",
        "Identifiers with the most entries.",
    ),
    Canned(
        "Recent messages",
        "SELECT * FROM logs ORDER BY timestamp DESC, file DESC, line_no DESC LIMIT 50",
        "The latest fifty entries.",
    ),
    Canned(
        "By hostname",
        "SELECT hostname, COUNT(*) AS count FROM logs GROUP BY hostname ORDER BY 2 DESC, 1",
        "Entries per host.",
    ),
]
JSON_BY_LEVEL = Canned(
    "By level", "SELECT level, COUNT(*) AS count FROM logs GROUP BY level ORDER BY 2 DESC, 1", "Rows per level."
)
JSON_FIRST = Canned("First 100 rows", "SELECT * FROM logs ORDER BY file, line_no LIMIT 100", "The first hundred rows.")
JSON_ERRORS = Canned(
    "Errors",
    "SELECT * FROM logs WHERE level = 'error' ORDER BY timestamp DESC, file DESC, line_no DESC LIMIT 100",
    "The latest rows at level error.",
)
JSON_RECENT = Canned(
    "Recent by timestamp",
    "SELECT * FROM logs ORDER BY timestamp DESC, file DESC, line_no DESC LIMIT 100",
    "The latest hundred rows.",
)
JSON_COUNT = Canned("Row count", "SELECT COUNT(*) AS total FROM logs", "Number of rows.")
JSON_COLUMNS = Canned(
    "Schema columns", "SELECT name, type FROM logs_columns ORDER BY cid", "Columns found in this file."
)
GENERIC = [
    Canned("First rows", "SELECT * FROM logs ORDER BY file, line_no LIMIT 100", "The first hundred lines."),
    Canned("Search message", "SELECT * FROM logs WHERE message ILIKE '%error%'", "Lines that mention an error."),
    Canned("Line count", "SELECT COUNT(*) AS total FROM logs", "Number of lines."),
    Canned("Recent lines", "SELECT * FROM logs ORDER BY file DESC, line_no DESC LIMIT 100", "The last hundred lines."),
    Canned("Distinct levels", "SELECT DISTINCT level FROM logs WHERE level IS NOT NULL", "Levels that occur."),
]
HELP = [
    Canned("Status counts", "SELECT status, COUNT(*) AS n FROM logs GROUP BY status", "Responses per status code."),
    Canned(
        "Some server errors",
        "SELECT * FROM logs WHERE status >= 500 ORDER BY file, line_no LIMIT 50",
        "Fifty requests answered with a 5xx status.",
    ),
    Canned(
        "Top paths",
        "SELECT path, COUNT(*) AS hits FROM logs GROUP BY path ORDER BY hits DESC, path LIMIT 20",
        "Paths with the most requests.",
    ),
]


def suggested_queries(format_name: str, columns: list[str] | None = None) -> list[Canned]:
    """The analyses for a format; for JSON only those whose columns exist."""
    if format_name in ("nginx_access", "apache_access"):
        return ACCESS
    if format_name == "syslog":
        return SYSLOG
    if format_name == "journald":
        return JOURNALD
    if format_name == "json":
        has = set(["level", "timestamp"] if columns is None else columns)
        return (
            ([JSON_BY_LEVEL] if "level" in has else [])
            + [JSON_FIRST, JSON_ERRORS]
            + ([JSON_RECENT] if {"level", "timestamp"} <= has else [])
            + [JSON_COUNT, JSON_COLUMNS]
        )
    return GENERIC


def quick_queries(format_name: str, columns: list[str] | None = None) -> list[Canned]:
    return suggested_queries(format_name, columns)[:3]


# The formats that have analyses.
_FORMATS = ["nginx_access", "apache_access", "syslog", "journald", "json", "generic"]


def suggestions_for(detection: DataFrame) -> DataFrame:
    """(file, format, n, label, sql, about): the analyses offered for each detected file."""
    rows = [
        (name, n, c.label, c.sql, c.about)
        for name in _FORMATS
        for n, c in enumerate(suggested_queries(name), start=1)
    ]
    menu = detection.sparkSession.createDataFrame(rows, "format string, n int, label string, sql string, about string")
    # The menu is a fixed list of some thirty rows.
    return detection.select("file", "format").join(F.broadcast(menu), "format")


def run(query: Canned, logs: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Runs a canned query on a table without registering a view."""
    text = query.sql.replace("logs_columns", "{columns}").replace("FROM logs", "FROM {logs}")
    if "file" not in logs.columns:
        # The lines of one file: their numbers are unique.
        text = text.replace(" file DESC,", "").replace(" file,", "")
    given = {"logs": logs} if "{logs}" in text else {}
    if "{columns}" in text:
        given["columns"] = columns
    return logs.sparkSession.sql(text, **given)
