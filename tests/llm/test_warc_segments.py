import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from timberline.llm import warc_segments as warc
from timberline.llm.common import Scratch
from timberline.llm.queries import ORACLES, QUERIES

DDL = "page_id long, url string, html string, kind string, sha int"
LONG = "ö<p>" * 900
ROWS = [
    (1, "http://one.test/", LONG, "x", 1),
    (7, "http://two.test/\r\nWARC-Type: metadata", LONG, "x", 1),
    (3, None, LONG, None, 1),
    (3, None, LONG, None, 1),
    (4, "u", None, "x", None),
    (None, "u", "", "x", 1),
    (None, None, "short", "x", 1),
    (8, "u", "short", "x", 1),
    (9, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40, "x", 1),
    (10, "u", "ends in line ends\r\n\r\n\r\n" + "WARC/1." * 300, "x", 1),
    (11, "u", "é" * 700_000, "x", 1),
]


def plain(rows, least=1000):
    """What each row must give, by looking at all rows."""
    out = []
    seen = set()
    for k, (key, url, html, *_) in enumerate(rows):
        data = (html or "").encode()
        order = [(r[0] is not None, r[0], r[1] is not None, r[1] or "") for r in rows if (r[2] or "").encode() == data]
        mine = (key is not None, key, url is not None, url or "")
        first = mine == max(order, key=lambda o: (o[0], o[1] or 0, o[2], o[3])) and data not in seen
        if first:
            seen.add(data)
        response = len(data) < least or first
        refers = None if response else max((o[1] for o in order if o[0]), default=None)
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", refers, True))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment,chunk", [(1 << 20, 1 << 16), (700, 333), (100_000, 5)])
def test_round_trip(spark, segment, chunk):
    rows = ROWS if chunk > 5 else ROWS[:-1]
    found = warc.round_trip(spark.createDataFrame(rows, DDL).repartition(3), Scratch(spark), segment=segment, chunk=chunk)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)


def test_false_openings_in_small_splits(spark, small_splits):
    rows = [(k, "u", f"{k} " * (k % 37) + "WARC/1.0\r\n\r\n" * (k % 5), "x", 1) for k in range(400)]
    path = warc.write(spark.createDataFrame(rows, DDL).coalesce(1), Scratch(spark), segment=50, chunk=20, compression="none")
    found = {int(r.key): r for r in warc.read(spark, path, Scratch(spark)).collect()}
    assert len(found) == len(rows) and all(r.whole for r in found.values())
    assert all(bytes(found[k].payload).decode() == html for k, _, html, *_ in rows)


def record(kind, name, block, *fields, length=None):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *fields, f"Content-Length: {len(block) if length is None else length}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Segments out of order and in several files, missing and repeated ones, wrong totals, broken framing."""
    http = b"HTTP/1.1 200 OK\r\ntransfer-encoding: gzip, chunked\r\n\r\n"
    second = [
        record("continuation", "a3", b"ghi", "WARC-Segment-Origin-ID: <a>", "WARC-Segment-Number: 3", "WARC-Segment-Total-Length: 9"),
        record("response", "c", http + b"4;x=1\r\nWARC\r\nA\r\n/1.1\r\nWARC\r\n0\r\nTrailer: t\r\n\r\n"),
        record("continuation", "lost", b"zz", "WARC-Segment-Origin-ID: <nowhere>", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 4"),
        record("response", "d", http + b"5\r\nab"),
        record("resource", "cut", b"only a part", length=5000),
    ]
    first = [
        record("warcinfo", "i", b"software: none"),
        record("continuation", "a2", b"def", "WARC-Segment-Origin-ID: <a>", "warc-segment-number: 2"),
        record("resource", "a", b"abc", "WARC-Segment-Number: 1", "X-Row-Key: 5%25"),
        record("resource", "b", b"abc", "WARC-Segment-Number: 1"),
        record("continuation", "b2", b"x", "WARC-Segment-Origin-ID: <b>", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 5"),
        record("resource", "e", b""),
    ]
    (tmp_path / "1.warc").write_bytes(b"".join(first))
    (tmp_path / "2.warc").write_bytes(b"".join(second))
    found = {r.record_id: (r.kind, bytes(r.payload), r.whole) for r in warc.read(spark, str(tmp_path), Scratch(spark)).collect()}
    assert found == {
        "<i>": ("warcinfo", b"software: none", True),
        "<a>": ("resource", b"abcdefghi", True),
        "<b>": ("resource", b"abcx", False),
        "<c>": ("response", b"WARC/1.1\r\nWARC", True),
        "<nowhere>": ("continuation", b"zz", False),
        "<d>": ("response", b"ab", False),
        "<e>": ("resource", b"", True),
        "<cut>": ("resource", b"only a part\r\n\r\n", False),
    }


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], DDL), Scratch(spark)).collect() == []


def test_other_id_types(spark):
    rows = [("a b\n", "u", "x" * 1200), ("c%", "u", "x" * 1200)]
    found = warc.round_trip(spark.createDataFrame(rows, "k string, url string, html string"), Scratch(spark), id_col="k")
    assert sorted(found.select("k", "record_type", "refers_to").collect()) == [("a b\n", "revisit", "c%"), ("c%", "response", None)]
    assert found.select(F.count_if("whole")).first()[0] == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver tables")
def test_query_against_its_sql(spark):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    found = QUERIES["op13_warc_segments"](spark, "/root/testdata/sf0.001")
    expected = connection.sql(ORACLES["op13_warc_segments"])
    assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(expected.fetchall())
