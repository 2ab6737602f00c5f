"""WARC archives: written with chunked framing and segments, read back whole.

Writing. Each page becomes an HTTP response in chunked transfer framing. Pages of
equal payload (``least`` bytes or more) are kept once; the others are revisit
records that refer to it. A block of more than ``segment`` bytes is cut: the first
record has segment number 1, and continuation records name its id as their origin.
Records are made of built-in expressions and written by Spark's text writer.

Reading. Spark's text reader cuts files at ``WARC/1.``, in parallel and without
holding a file. Where those characters stand inside a payload, the cut is false:
such a piece has not the length that its header declares. Files that hold such
pieces are cut again by declared lengths, within *islands*, the stretches of a file
over which declared records overlap. Continuation records are then grouped by
origin, ordered by segment number and checked against the total length, and the
chunked framing is taken off.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timberline.llm.common import Scratch, bitmap, fresh, marked, place
from timberline.session import scratch_path

LEAST = 1000
SEGMENT = 1 << 20
CHUNK = 1 << 16

# What the format prescribes.
_OPENING = "WARC/1."
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_KEY = "X-Row-Key"


# Writing


def _id(*parts) -> Column:
    """A record id from a hash of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _slices(data: Column, size: int) -> Column:
    """The bytes in pieces of ``size``, the last one shorter; none of no bytes."""
    starts = F.sequence(F.lit(1), F.octet_length(data), F.lit(size))
    return F.when(F.octet_length(data) > 0, F.transform(starts, lambda at: F.substring(data, at, F.lit(size)))).otherwise(F.array().cast("array<binary>"))


def _chunked(payload: Column, size: int) -> Column:
    # Bytes cast to a string stay as they are, whether they are UTF-8 or cut amid a character.
    def framed(part: Column) -> Column:
        return F.concat(F.lower(F.hex(F.octet_length(part))), F.lit("\r\n"), part.cast("string"), F.lit("\r\n"))

    return F.concat(F.array_join(F.transform(_slices(payload, size), framed), ""), F.lit("0\r\n\r\n"))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")


def _lines(df: DataFrame, segment: int) -> DataFrame:
    """One row ``record`` for each record: (kind, record_id, uri, key, digest, refers_to, block) with long blocks cut."""
    block = F.col("block")
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(block) / segment))
    parts = F.when(count > 1, _slices(block.cast("binary"), segment)).otherwise(F.array(block.cast("binary")))
    cut = df.withColumns({"_count": count, "_total": F.octet_length(block)})
    cut = cut.select("kind", "record_id", "uri", "key", "digest", "refers_to", "_count", "_total", F.posexplode(parts).alias("_at", "_part"))
    first, number = F.col("_at") == 0, F.col("_at") + 1
    many = F.col("_count") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(first, F.col("kind")).otherwise("continuation"),
        F.lit("\r\nWARC-Record-ID: "),
        F.when(first, F.col("record_id")).otherwise(_id("continuation", F.col("record_id"), number)),
        F.lit("\r\nWARC-Date: "),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\n"),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        F.when(first, _field(_KEY, F.col("key"))).otherwise(""),
        F.when(first & (F.col("kind") == "revisit"), F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), F.col("refers_to"), F.lit("\r\n"))).otherwise(""),
        _field("WARC-Segment-Number", F.when(many, number)),
        _field("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        _field("WARC-Segment-Total-Length", F.when(many & (number == F.col("_count")), F.col("_total"))),
        F.when(first, F.lit("Content-Type: application/http; msgtype=response\r\n")).otherwise(""),
        F.lit("Content-Length: "),
        F.octet_length("_part").cast("string"),
        F.lit("\r\n\r\n"),
    )
    return cut.select(F.concat(head, F.col("_part").cast("string")).alias("record"))


def write(
    pages: DataFrame,
    scratch: Scratch,
    path: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = LEAST,
    segment: int = SEGMENT,
    chunk: int = CHUNK,
    compression: str = "gzip",
) -> str:
    """Writes archives of all pages into a new folder and gives its path.

    A null payload is empty. Of equal payloads of ``least`` bytes or more, the row with
    the largest id (then url, then any one of equal rows) is the response; null ids are
    the smallest. An id is kept as text in a field of its own. Only groups whose payload
    occurs again are shuffled, the payload once for each task that holds it; a bitmap of
    2 MB tells most other rows, which are written where they are read.
    """
    spark, path = pages.sparkSession, path or scratch_path(pages.sparkSession, "warc")
    salt = uuid.uuid4().hex
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    clean = F.col(url_col).cast("string")
    for bad in ("\r", "\n"):
        clean = F.replace(clean, F.lit(bad), F.lit(f"%{ord(bad):02X}"))
    rows = pages.select(F.col(id_col).alias("id"), clean.alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")})
    facts = rows.withColumn("row", F.monotonically_increasing_id())
    facts = scratch.keep(facts.select("row", "id", "uri", "sha", "size", F.sha1("payload").alias("digest"), place("sha").alias("at")), "warc-rows")

    again = facts.filter(F.col("size") >= least).groupBy("sha", "at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("at").distinct()
    bits = bitmap(again)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("at"), "shared", marked(bits, batch.column("at")))

    # Every row of a shared payload is among these, and some others; a group of one has no revisits.
    shared = facts.filter(F.col("size") >= least).mapInArrow(known, facts.drop("at").schema.add("shared", "boolean")).filter("shared")
    shared = scratch.keep(shared.drop("shared"), "warc-shared")
    latest = shared.groupBy("sha").agg(F.max(F.struct(F.col("id"), F.col("uri"), F.col("row"))).alias("last"))
    latest = scratch.keep(latest.select("sha", "last.*"), "warc-latest")

    key, none = F.url_encode(F.col("id").cast("string")), F.lit(None).cast("string")
    block = F.concat(F.lit(_HTTP), _chunked(F.col("payload").cast("binary"), chunk))
    # A row that shares its payload is known by its hash; the payload is then taken from any row that has it.
    tests = rows.withColumn("at", place("sha")).mapInArrow(known, rows.schema.add("shared", "boolean"))
    tests = tests.withColumn("shared", F.col("shared") & (F.col("size") >= least))
    number = F.monotonically_increasing_id()
    single = tests.filter("NOT shared").select(
        F.lit("response").alias("kind"), _id(salt, "row", number).alias("record_id"), "uri", key.alias("key"), F.sha1("payload").alias("digest"), none.alias("refers_to"), block.alias("block")
    )
    held = tests.filter("shared").groupBy("sha").agg(F.any_value("payload").alias("payload"))
    first = latest.join(held, "sha").select(
        F.lit("response").alias("kind"), _id(salt, "payload", F.hex("sha")).alias("record_id"), "uri", key.alias("key"), F.sha1("payload").alias("digest"), none.alias("refers_to"), block.alias("block")
    )
    revisits = shared.join(latest.select("sha", F.col("row").alias("_first")), "sha").filter("row <> _first").select(
        F.lit("revisit").alias("kind"), _id(salt, "revisit", F.col("row")).alias("record_id"), "uri", key.alias("key"), "digest", _id(salt, "payload", F.hex("sha")).alias("refers_to"), F.lit(_HTTP).alias("block")
    )
    records = _lines(single.unionByName(first).unionByName(revisits), segment)
    records.write.option("lineSep", _END).option("compression", compression).text(path)
    scratch.drop("warc-rows", "warc-shared", "warc-latest")
    return path


# Reading


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _sized(pieces: DataFrame) -> DataFrame:
    """Adds ``head``, ``size`` in bytes, and ``declared``, up to the end of the block; NULL without a valid header."""
    head = F.substring_index("value", _END, 1)
    length = _header(F.col("head"), "Content-Length").try_cast("bigint")
    valid = F.col("head").rlike(r"\A[01]\r\n") & (length >= 0) & (F.octet_length("head") < F.octet_length("value"))
    sized = pieces.withColumns({"head": head, "size": F.octet_length("value").cast("long")})
    return sized.withColumn("declared", F.when(valid, F.octet_length("head") + len(_END) + length))


def _records_in(data: bytes) -> Iterator[bytes]:
    """Cuts bytes that follow an opening into records by declared lengths; what is no record is left out."""
    opening, at = _OPENING.encode(), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        fields = data[at:end].lower().split(b"\r\n") if end >= 0 else []
        length = next((f.partition(b":")[2].strip() for f in fields if f.startswith(b"content-length:")), b"")
        if data[at : at + 3] in (b"0\r\n", b"1\r\n") and length.isdigit():
            stop = end + 4 + int(length)
            yield data[at:stop] + (b"\r\n\r\n" if stop <= len(data) else b"")
            at = stop
        following = data.find(opening, at)
        at = len(data) if following < 0 else following + len(opening)


def _recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("value").cast(pa.binary()):
            found = list(_records_in(value.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])


def _pieces(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(value): all records, without the opening ``WARC/1.``"""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", _OPENING).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    sized = _sized(lines)
    # The text before a file's first record is empty.
    opening = (F.col("block") == 0) & (F.col("size") == 0)
    exact = F.coalesce(F.col("size").isin(F.col("declared"), F.col("declared") + len(_END)), F.lit(False))
    odd = scratch.keep(sized.filter(~opening & ~exact).select("file").distinct(), "warc-odd")
    if odd.isEmpty():
        return sized.filter(~opening).select("value")
    even = sized.filter(~opening).join(odd, "file", "left_anti").select("value")
    torn = scratch.keep(sized.join(odd, "file", "left_semi").select("file", "block", "pos", "value", "size", "declared"), "warc-torn")
    in_file = W.partitionBy("file").orderBy("block", "pos")
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + len(_OPENING)).over(before), F.lit(0))
    whole = F.sum(F.col("size") + len(_OPENING)).over(W.partitionBy("file"))
    places = torn.select("file", "block", "pos", start.alias("start"), whole.alias("whole"), "size", "declared")
    # A length beyond the file's end is a broken one.
    end = F.col("start") + F.coalesce(F.col("declared"), F.col("size"))
    places = places.withColumn("end", F.when(end <= F.col("whole"), end).otherwise(F.col("start") + F.col("size")))
    # An opening that ends where a block does belongs to that block.
    begins = F.col("start") - len(_OPENING) >= F.coalesce(F.max("end").over(before), F.lit(-len(_OPENING)))
    places = places.withColumn("begins", begins).select("file", "block", "pos", F.sum(F.col("begins").cast("long")).over(in_file).alias("island"))
    parts = F.array_sort(F.collect_list(F.struct("block", "pos", "value")))
    islands = torn.join(places, ["file", "block", "pos"]).groupBy("file", "island").agg(F.array_join(F.transform(parts, lambda p: p["value"]), _OPENING).alias("value"))
    # Bytes travel to Python as bytes; they need not be text.
    again = islands.select(F.col("value").cast("binary").alias("value")).mapInArrow(_recut, "value binary")
    return even.unionByName(again.select(F.col("value").cast("string").alias("value")))


def dechunked(body: bytes) -> tuple[bytes, bool]:
    """The bytes without their chunked framing, and whether it was whole; what can be read is kept."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return b"".join(parts), False
        size = int(digits, 16)
        if size == 0:
            return b"".join(parts), True
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return b"".join(parts), False
        at += 2


def _payload(block: bytes) -> tuple[bytes, bool]:
    """The payload of an HTTP message, and whether its framing was whole."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not mark:
        return block, not head.startswith(b"HTTP/")
    for line in head.lower().split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip() == b"transfer-encoding" and value.strip().endswith(b"chunked"):
            return dechunked(body)
    return body, True


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, kinds = batch.schema.get_field_index("block"), batch.column("kind").to_pylist()
        found = [(b"", True) if kind == "revisit" else _payload(b.as_py()) for kind, b in zip(kinds, batch.column("block"))]
        out = batch.set_column(at, "payload", pa.array([p for p, _ in found], pa.binary()))
        yield out.append_column("framed", pa.array([ok for _, ok in found], pa.bool_()))


def read(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(record_id, kind, uri, key, digest, refers_to, payload, whole) of every record of the archives under ``path``.

    Continuation records are joined to their origin. ``whole`` is false where segments are
    missing or repeated, the total length differs, the block is shorter than declared, or
    the chunked framing is broken; the payload then holds what there is. A continuation
    whose origin is nowhere is a record of kind ``continuation`` that isn't whole. The
    payload of a revisit is empty. An empty folder gives no rows.
    """
    head, names = F.col("head"), {"record_id": "WARC-Record-ID", "kind": "WARC-Type", "uri": "WARC-Target-URI", "key": _KEY, "digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
    data = F.col("value").cast("binary")
    length = F.col("declared") - F.octet_length("head") - len(_END)
    records = _sized(_pieces(spark, path, scratch)).select(
        *[_header(head, field).alias(name) for name, field in names.items()],
        _header(head, "WARC-Segment-Number").try_cast("int").alias("number"),
        _header(head, "WARC-Segment-Origin-ID").alias("origin"),
        _header(head, "WARC-Segment-Total-Length").try_cast("bigint").alias("total"),
        F.substring(data, F.octet_length("head") + len(_END) + 1, length.cast("int")).alias("block"),
        (F.col("size") >= F.col("declared")).alias("sound"),
    )
    alone = records.filter("number IS NULL").select(*names, "block", F.coalesce("sound", F.lit(False)).alias("sound"))
    parts = F.array_sort(F.collect_list(F.struct("number", F.col("block").cast("string").alias("block"), *[n for n in names if n != "record_id"], "sound", "total")))
    joined = records.filter("number IS NOT NULL").groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(parts.alias("parts"))
    first, size = F.col("parts")[0], F.size("parts")
    block = F.array_join(F.transform("parts", lambda p: p["block"]), "").cast("binary")
    sound = (
        (F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1), size))
        & F.forall("parts", lambda p: F.coalesce(p["sound"], F.lit(False)))
        & (F.octet_length("block") == F.element_at("parts", -1)["total"])
    )
    segmented = joined.withColumn("block", block).select(
        "record_id", *[first[n].alias(n) for n in names if n != "record_id"], "block", F.coalesce(sound, F.lit(False)).alias("sound")
    )
    both = alone.unionByName(segmented)
    schema = ", ".join([f"{n} string" for n in names] + ["payload binary", "sound boolean", "framed boolean"])
    decoded = both.mapInArrow(_decoded, schema)
    digest = F.regexp_replace("digest", "^(?i)sha1:", "")
    return decoded.select(
        "record_id", "kind", "uri", F.try_url_decode("key").alias("key"), digest.alias("digest"), "refers_to", "payload", (F.col("sound") & F.col("framed")).alias("whole")
    )


def round_trip(
    pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, segment: int = SEGMENT, chunk: int = CHUNK
) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, whole) of every row, as read back from archives written of it.

    A revisit has the size and digest of the payload it refers to. Null, empty and repeated rows are rows
    like any other; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    path = write(pages, scratch, None, id_col, url_col, html_col, least, segment, chunk)
    found = read(pages.sparkSession, path, scratch)
    facts = found.select("record_id", "kind", "key", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "whole")
    facts = scratch.keep(facts, "warc-read")
    kind = pages.schema[id_col].dataType
    key, refers = F.col("key").cast(kind), fresh(pages.select(id_col), "refers_to")
    shown = ["payload_bytes", "payload_digest", F.col("kind").alias("record_type")]
    own = facts.filter("kind <> 'revisit'").select(key.alias(id_col), *shown, F.lit(None).cast(kind).alias(refers), "whole")
    origin = facts.filter("kind = 'response'").select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest", key.alias("_origin"), F.col("whole").alias("_whole"))
    revisits = facts.filter("kind = 'revisit'").drop("payload_bytes", "payload_digest").join(origin, "refers_to", "left")
    revisits = revisits.select(key.alias(id_col), *shown, F.col("_origin").alias(refers), (F.col("whole") & F.coalesce("_whole", F.lit(False))).alias("whole"))
    return own.unionByName(revisits)
