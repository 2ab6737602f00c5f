"""Timestamps as ISO-8601 UTC text with milliseconds.

All of it is arithmetic on epoch values and TIMESTAMP_NTZ, so the session time
zone never matters, and out-of-range days or hours roll over instead of failing.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions.once import let
from timberline.functions.text import NON_WS, WS, matches, trim

# The month names, the largest time, and the shapes of times that are read.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
MAX_MILLIS = 8_640_000_000_000_000

_ACCESS_TIME = rf"^\d{{1,2}}/[A-Z][a-z]{{2}}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}{WS}+[+-]\d{{4}}\z"
_EPOCH = r"^\d{10,13}\z"
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\z"
_DATE = r"^\d{4}-\d{2}-\d{2}\z"
_DATE_TIME = r"^\d{4}([-/])\d{2}\1\d{2} \d{2}:\d{2}:\d{2}\z"
_SYSLOG_PREFIX = rf"^({NON_WS}+){WS}+(\d{{1,2}}){WS}+(\d{{2}}):(\d{{2}}):(\d{{2}})"
_RFC_2822 = (
    rf"^(?:[A-Z][a-z]{{2}},?{WS}+)?(\d{{1,2}}){WS}+([A-Z][a-z]{{2}}){WS}+(\d{{4}}){WS}+"
    rf"(\d{{2}}):(\d{{2}}):(\d{{2}})(?:{WS}+(GMT|UTC|Z|[+-]\d{{4}}))?\z"
)
_CANDIDATE = (
    rf"^{WS}*+(?:\d{{10,13}}{WS}*\z|\d{{4}}[-/]\d\d[-/]\d\d|\d{{1,2}}{WS}+[A-Z][a-z]{{2}}{WS}"
    rf"|[A-Z][a-z]{{2}},?{WS}+\d)"
)


_EPOCH_START = "timestamp_ntz'1970-01-01 00:00:00'"


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def _date_and_clock(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``, with a six-digit signed year past 9999."""
    stamp = F.timestamp_add("SECOND", seconds, F.expr(_EPOCH_START)).cast("string")
    return F.regexp_replace(F.replace(stamp, F.lit(" "), F.lit("T")), r"^([+-])(?=\d{5}-)", "$10")


def iso_seconds(seconds: Column) -> Column:
    """Epoch seconds as ISO-8601 UTC text."""
    return F.concat(_date_and_clock(seconds), F.lit(".000Z"))


def iso_text(millis: Column) -> Column:
    """Epoch milliseconds as ISO-8601 UTC text."""

    def text(ms: Column) -> Column:
        fraction = F.pmod(ms, F.lit(1000))
        digits = F.lpad(fraction.cast("string"), 3, "0")
        return F.concat(_date_and_clock(_div(ms - fraction, 1000)), F.lit("."), digits, F.lit("Z"))

    return let(millis, text)


def month_number(name: Column) -> Column:
    """1..12, or NULL for a token that is no month."""
    at = F.instr(F.lit(MONTHS), name)
    return F.when((at > 0) & (F.length(name) == 3) & (at % 3 == 1), F.floor((at + 2) / 3).cast("int"))


def civil_seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Epoch seconds of a UTC date whose day and clock fields may overflow; NULL without a month."""
    days = F.unix_date(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))).cast("bigint") + day.cast("int") - 1
    return days * 86400 + hour.cast("int") * 3600 + minute.cast("int") * 60 + second.cast("int")


def _zone_seconds(zone: Column) -> Column:
    """Seconds east of UTC of ``+hhmm``, ``+hh:mm`` or a zero-offset name."""
    digits = F.replace(zone, F.lit(":"), F.lit(""))
    minutes = F.substring(digits, 2, 2).cast("int") * 60 + F.substring(digits, 4, 2).cast("int")
    return (
        F.when(zone.startswith("-"), -minutes * 60).when(zone.startswith("+"), minutes * 60).otherwise(0).cast("bigint")
    )


def access_seconds(time_local: Column) -> Column:
    """Epoch seconds of ``dd/Mon/yyyy:HH:MM:SS ±hhmm``; NULL on another shape or an unknown month."""
    slash = F.instr(time_local, "/")

    def piece(offset, length):
        return F.substring(time_local, slash + offset, F.lit(length))

    year = piece(5, 4).cast("int")
    seconds = civil_seconds(
        F.when(year < 100, year + 1900).otherwise(year),
        month_number(piece(1, 3)),
        F.substring(time_local, F.lit(1), slash - 1),
        piece(10, 2),
        piece(13, 2),
        piece(16, 2),
    ) - _zone_seconds(F.right(time_local, F.lit(5)))
    return F.when(matches(time_local, _ACCESS_TIME), seconds)


def utc_seconds(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp")) / 1_000_000


def _utc_year(moment: Column) -> Column:
    days = F.floor(utc_seconds(moment) / 86400).cast("int")
    return F.year(F.date_from_unix_date(days))


def yearless_seconds(month: Column, day: Column, clock: Column, now: Column) -> Column:
    """Epoch seconds of ``Mon d HH:MM:SS`` in the UTC year of ``now``."""
    return civil_seconds(
        _utc_year(now), month_number(month), day,
        F.substring(clock, 1, 2), F.substring(clock, 4, 2), F.substring(clock, 7, 2),
    )


def not_ahead(seconds: Column, now: Column) -> Column:
    """The same date a year earlier if it lies more than a day after ``now``."""

    def moved(s: Column) -> Column:
        date, zero = F.date_from_unix_date(F.floor(s / 86400).cast("int")), F.lit(0)
        earlier = civil_seconds(F.year(date) - 1, F.month(date), F.day(date), zero, zero, zero)
        return F.when(s - utc_seconds(now) > 86400, earlier + F.pmod(s, F.lit(86400))).otherwise(s)

    return let(seconds, moved)


def epoch_millis(digits: Column) -> Column:
    """Digits as epoch: over 13 of them are microseconds, else milliseconds."""
    value = digits.try_cast("bigint")
    millis = F.when(F.length(digits) > 13, _div(value, 1000)).otherwise(value)
    return F.when(digits.rlike(r"^\d+\z") & (millis <= MAX_MILLIS), millis)


def time_candidate(line: Column) -> Column:
    """The trimmed line if it can hold a timestamp at all, else NULL: a cheap first test."""
    return F.when(matches(line, _CANDIDATE), trim(line))


def best_effort_millis(text: Column, now: Column) -> Column:
    """Epoch milliseconds of the timestamp that a trimmed line is or starts with, else NULL."""

    def at(start, length):
        return F.substring(text, start, length)

    def group(pattern, n):
        return F.regexp_extract(text, pattern, n)

    number = text.try_cast("bigint")
    epoch = F.when(number > 1_000_000_000_000, number).otherwise(number * 1000)
    day_ok = at(6, 2).between("01", "12") & at(9, 2).between("01", "31")
    clock_ok = (at(15, 2) <= "59") & (at(18, 2) <= "59") & ((at(12, 2) <= "23") | (at(12, 8) == "24:00:00"))
    dated = civil_seconds(at(1, 4), at(6, 2), at(9, 2), at(12, 2), at(15, 2), at(18, 2)) * 1000
    fraction = F.rpad(group(r"\.(\d{1,3})", 1), 3, "0").cast("bigint")
    zone = group(r"T.*(Z|[+-]\d{2}:?\d{2})\z", 1)
    midnight = F.lit(0)
    date_only = civil_seconds(at(1, 4), at(6, 2), at(9, 2), midnight, midnight, midnight) * 1000
    syslog = civil_seconds(
        _utc_year(now), month_number(group(_SYSLOG_PREFIX, 1)), *[group(_SYSLOG_PREFIX, n) for n in (2, 3, 4, 5)]
    )
    mail = civil_seconds(
        group(_RFC_2822, 3), month_number(group(_RFC_2822, 2)), *[group(_RFC_2822, n) for n in (1, 4, 5, 6)]
    ) - _zone_seconds(group(_RFC_2822, 7))
    return (
        F.when(text.rlike(_EPOCH), epoch)
        .when(text.rlike(_ISO), F.when(day_ok & clock_ok, dated - _zone_seconds(zone) * 1000 + fraction))
        .when(matches(text, _SYSLOG_PREFIX), syslog * 1000)
        .when(text.rlike(_DATE_TIME), F.when(day_ok & clock_ok, dated))
        .when(text.rlike(_DATE), F.when(day_ok, date_only))
        .when(matches(text, _RFC_2822), mail * 1000)
    )


def event_time(timestamp: Column) -> Column:
    """The ISO text as a typed UTC value; NULL if it does not parse."""
    return timestamp.try_cast("timestamp")
