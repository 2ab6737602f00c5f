"""RFC 3164 syslog lines, with or without the <PRI> part."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.once import let, with_captured, with_once
from timberline.functions.text import ANY, NON_WS, SPACES, WS, blank_to_null, capture, matches
from timberline.functions.times import iso_seconds, not_ahead, yearless_seconds
from timberline.operators.frame import project

# Fixed values: <pri>month day clock host rest, and tag[pid]: message within rest.
SYSLOG_LINE = (
    rf"^(?:<(\d{{1,3}})>)?([A-Z][a-z]{{2}}){WS}++(\d{{1,2}}){WS}++(\d{{2}}:\d{{2}}:\d{{2}}){WS}++"
    rf"({NON_WS}++){WS}+({ANY}+)\z"
)
TAGGED = rf"^([^\s{SPACES}:\[]+)(?:\[(\d+)\])?:{WS}?({ANY}*)\z"


def is_syslog(raw: Column) -> Column:
    return matches(raw, SYSLOG_LINE)


def parse_syslog(lines: DataFrame, ref_time: Column | None = None) -> DataFrame:
    """``ref_time`` is the moment that decides the year; the start of the query by default."""
    now = F.current_timestamp() if ref_time is None else ref_time
    raw = F.col("raw")
    matched = with_captured(lines, "_f", capture(raw, SYSLOG_LINE, [1, 2, 3, 4, 5, 6]), 6)
    pri, month, day, clock, host, rest = [F.col("_f")[i] for i in range(6)]
    priority = pri.try_cast("bigint")
    untagged = F.array(F.lit(""), F.lit(""), rest)
    parts = let(capture(rest, TAGGED, [1, 2, 3]), lambda p: F.when(F.size(p) == 3, p).otherwise(untagged))
    matched = with_once(matched, "_t", parts)
    tag, pid, message = [F.col("_t")[i] for i in range(3)]
    return project(
        matched,
        [
            ("priority", priority),
            ("facility", F.call_function("div", priority, F.lit(8))),
            ("severity", priority % 8),
            ("timestamp", iso_seconds(not_ahead(yearless_seconds(month, day, clock, now), now))),
            ("hostname", host),
            ("tag", blank_to_null(tag)),
            ("pid", pid.try_cast("bigint")),
            ("message", blank_to_null(message)),
        ],
    )
