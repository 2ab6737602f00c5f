"""Web access lines (common and combined layout, optional virtual host)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.once import with_captured
from timberline.functions.text import NON_WS, WS, blank_to_null, capture, dash_to_null, matches
from timberline.functions.times import access_seconds, iso_seconds
from timberline.operators.frame import project

# Address, logname, user, [time], "request", status, bytes, then
# optionally "referer" "agent"; the virtual host, where given, comes first.
_BODY = (
    rf'({NON_WS}++){WS}++({NON_WS}++){WS}++({NON_WS}++){WS}++\[([^\]]++)\]{WS}++"([^"]*+)"{WS}++'
    rf'(\d{{3}}){WS}++(\d++|-)(?:{WS}++"([^"]*+)"{WS}++"([^"]*+)")?{WS}*+\z'
)
NGINX_LINE = "^" + _BODY
APACHE_LINE = rf"^(?:{NON_WS}++{WS}++)?{_BODY}"

_ADDR, _USER, _TIME, _REQUEST, _STATUS, _BYTES, _REFERER, _AGENT = 1, 3, 4, 5, 6, 7, 8, 9


def is_nginx(raw: Column) -> Column:
    return matches(raw, NGINX_LINE)


def is_apache(raw: Column) -> Column:
    return matches(raw, APACHE_LINE)


def split_request(request: Column) -> dict[str, Column]:
    """Method before the first space, protocol after the last, path between."""
    first = F.instr(request, " ")
    last = F.length(request) - F.length(F.substring_index(request, " ", -1))
    empty = request.isin("", "-")
    two = last > first
    rest = F.length(request)
    return {
        "method": F.when(~empty & (first > 0), blank_to_null(F.substring(request, F.lit(1), first - 1))),
        "path": F.when(
            ~empty,
            blank_to_null(
                F.when(first == 0, request)
                .when(two, F.substring(request, first + 1, last - first - 1))
                .otherwise(F.substring(request, first + 1, rest))
            ),
        ),
        "protocol": F.when(~empty & (first > 0) & two, blank_to_null(F.substring(request, last + 1, rest))),
    }


def _parse(lines: DataFrame, pattern: str) -> DataFrame:
    wanted = [_ADDR, _USER, _TIME, _REQUEST, _STATUS, _BYTES, _REFERER, _AGENT]
    matched = with_captured(lines, "_f", capture(F.col("raw"), pattern, wanted), len(wanted))
    addr, user, time, request, status, sent, referer, agent = [F.col("_f")[i] for i in range(len(wanted))]
    parts = split_request(request)
    return project(
        matched,
        [
            ("remote_addr", addr),
            ("remote_user", dash_to_null(user)),
            ("time_local", time),
            ("timestamp", iso_seconds(access_seconds(time))),
            ("method", parts["method"]),
            ("path", parts["path"]),
            ("protocol", parts["protocol"]),
            ("status", status.cast("bigint")),
            ("body_bytes_sent", sent.try_cast("bigint")),
            ("http_referer", dash_to_null(referer)),
            ("http_user_agent", dash_to_null(agent)),
        ],
    )


def parse_nginx(lines: DataFrame) -> DataFrame:
    return _parse(lines, NGINX_LINE)


def parse_apache(lines: DataFrame) -> DataFrame:
    """Access lines that may start with a virtual host, which is read past and dropped."""
    return _parse(lines, APACHE_LINE)
