import pytest
from pyspark.sql import functions as F

from timberline.operators.access import parse_apache, parse_nginx, split_request

COMBINED = (
    '198.51.100.23 - mira [07/Mar/2023:04:05:59 +0130] "PUT /stock/item-7.json HTTP/2.0" 201 918 '
    '"https://shop.test/cart" "Checkout/3.1 (kiosk)"'
)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


@pytest.mark.parametrize("parse", [parse_nginx, parse_apache])
def test_combined_line(lines, parse):
    row = one(parse(lines(COMBINED)))
    assert list(row) == [
        "file", "line_no", "raw", "remote_addr", "remote_user", "time_local", "timestamp", "method", "path",
        "protocol", "status", "body_bytes_sent", "http_referer", "http_user_agent",
    ]
    assert row["remote_addr"] == "198.51.100.23" and row["remote_user"] == "mira"
    assert row["time_local"] == "07/Mar/2023:04:05:59 +0130"
    assert row["timestamp"] == "2023-03-07T02:35:59.000Z"
    assert (row["method"], row["path"], row["protocol"]) == ("PUT", "/stock/item-7.json", "HTTP/2.0")
    assert (row["status"], row["body_bytes_sent"]) == (201, 918)
    assert row["http_referer"] == "https://shop.test/cart" and row["http_user_agent"] == "Checkout/3.1 (kiosk)"


def test_ipv6_and_dashes(lines):
    row = one(parse_nginx(lines('fe80::9:4 - - [07/Mar/2023:04:05:59 +0130] "HEAD /up HTTP/1.1" 204 - "-" "probe"')))
    assert row["remote_addr"] == "fe80::9:4" and row["status"] == 204
    assert row["remote_user"] is None and row["http_referer"] is None and row["body_bytes_sent"] is None


def test_common_line_has_no_referer(lines):
    row = one(parse_nginx(lines('h - - [21/Jun/2022:06:07:08 -0400] "GET / HTTP/1.1" 200 5')))
    assert row["http_referer"] is None and row["http_user_agent"] is None


def test_vhost_is_dropped(lines):
    line = 'img.shop.test 203.0.113.8 - mira [07/Mar/2023:04:05:59 +0130] "GET /logo HTTP/1.1" 304 0'
    row = one(parse_apache(lines(line)))
    assert row["remote_addr"] == "203.0.113.8" and row["path"] == "/logo"
    assert parse_nginx(lines(line)).count() == 0


def test_vhost_reading_comes_first(lines):
    row = one(parse_apache(lines('a b c [d [21/Jun/2022:06:07:08 -0400] "GET / HTTP/1.1" 200 1')))
    assert (row["remote_addr"], row["remote_user"], row["time_local"]) == ("b", "[d", "21/Jun/2022:06:07:08 -0400")


def test_no_match_is_skipped(lines):
    bad = lines(
        "~~ rotated by cron ~~",
        "",
        ' h - - [21/Jun/2022:06:07:08 -0400] "GET / HTTP/1.1" 200 5',
        'h - - [21/Jun/2022:06:07:08 -0400] "GET "x" HTTP/1.1" 200 5',
        'h - - [21/Jun/2022:06:07:08 -0400] "GET / HTTP/1.1" 20 5',
    )
    assert parse_nginx(bad).count() == 0


def test_any_white_space_separates_fields(lines):
    nbsp = chr(0xA0)
    row = one(parse_nginx(lines(f'h{nbsp}-\t- [21/Jun/2022:06:07:08{nbsp}+0000] "GET /ü HTTP/1.1" 200 5{nbsp}')))
    assert row["remote_addr"] == "h" and row["path"] == "/ü" and row["timestamp"] == "2022-06-21T06:07:08.000Z"


@pytest.mark.parametrize(
    "local, expected",
    [
        ("31/Feb/2001:10:00:00 +0000", "2001-03-03T10:00:00.000Z"),
        ("01/Jan/2001:25:61:61 +0000", "2001-01-02T02:02:01.000Z"),
        ("1/Jan/2001:00:00:00 +0530", "2000-12-31T18:30:00.000Z"),
        ("10/Foo/2001:00:00:00 +0000", None),
        ("10/Oct/2001 00:00:00 +0000", None),
        ("10/Oct/0099:00:00:00 +0000", "1999-10-10T00:00:00.000Z"),
        ("31/Dec/9999:25:00:00 +0000", "+010000-01-01T01:00:00.000Z"),
    ],
)
def test_timestamps(lines, local, expected):
    row = one(parse_nginx(lines(f'h - - [{local}] "GET / HTTP/1.1" 200 5')))
    assert row["timestamp"] == expected and row["time_local"] == local


@pytest.mark.parametrize(
    "request_text, expected",
    [
        ("POST /find?for=red shoes now HTTP/1.1", ("POST", "/find?for=red shoes now", "HTTP/1.1")),
        ("-", (None, None, None)),
        ("", (None, None, None)),
        ("/only", (None, "/only", None)),
        ("GET /a", ("GET", "/a", None)),
        (" /a", (None, "/a", None)),
        ("GET ", ("GET", None, None)),
        ("GET  HTTP/1.1", ("GET", None, "HTTP/1.1")),
        ("GET /a ", ("GET", "/a", None)),
    ],
)
def test_split_request(spark, request_text, expected):
    parts = split_request(F.col("r"))
    row = spark.createDataFrame([(request_text,)], "r string").select(*parts.values()).first()
    assert tuple(row) == expected
