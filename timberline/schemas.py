"""Column layouts of the parsed tables and the TEXT/INTEGER/REAL names shown for them."""

from pyspark.sql import types as T

TEXT, INTEGER, REAL = T.StringType(), T.LongType(), T.DoubleType()

BASE = [("line_no", INTEGER), ("raw", TEXT)]

# Column names and types of each format, after line_no and raw.
ACCESS = [
    ("remote_addr", TEXT),
    ("remote_user", TEXT),
    ("time_local", TEXT),
    ("timestamp", TEXT),
    ("method", TEXT),
    ("path", TEXT),
    ("protocol", TEXT),
    ("status", INTEGER),
    ("body_bytes_sent", INTEGER),
    ("http_referer", TEXT),
    ("http_user_agent", TEXT),
]
SYSLOG = [
    ("priority", INTEGER),
    ("facility", INTEGER),
    ("severity", INTEGER),
    ("timestamp", TEXT),
    ("hostname", TEXT),
    ("tag", TEXT),
    ("pid", INTEGER),
    ("message", TEXT),
]
JOURNALD = [
    ("timestamp", TEXT),
    ("priority", INTEGER),
    ("unit", TEXT),
    ("hostname", TEXT),
    ("identifier", TEXT),
    ("pid", INTEGER),
    ("message", TEXT),
]
GENERIC = [("timestamp", TEXT), ("level", TEXT), ("message", TEXT)]
JSON_PROMOTED = [("timestamp", TEXT), ("level", TEXT), ("message", TEXT)]


def struct(columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in BASE + list(columns)])


def display_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "INTEGER"
    if isinstance(kind, T.NumericType):
        return "REAL"
    return "TEXT"
