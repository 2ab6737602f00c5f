"""systemd journal exports: record assembly, then key=value or JSON parsing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from timberline.functions.json_text import (
    any_text,
    bind,
    is_number,
    json_object,
    value_at,
)
from timberline.functions.once import let, with_present
from timberline.functions.text import INLINE_WS, WS, has_text, lenient_int, matches, starts_indented, trim
from timberline.functions.times import epoch_millis, iso_text
from timberline.operators.frame import project
from timberline.sources.text_files import join_runs, numbered, numbering, with_block_facts

# The field names that mark an export, and the columns they fill.
FIELDS = {
    "timestamp": "__REALTIME_TIMESTAMP",
    "hostname": "_HOSTNAME",
    "unit": "_SYSTEMD_UNIT",
    "identifier": "SYSLOG_IDENTIFIER",
    "pid": "_PID",
    "priority": "PRIORITY",
    "message": "MESSAGE",
}
KEY_LINE = "^(?:" + "|".join(FIELDS.values()) + ")="

# A code point that is no character, so no log text holds it.
_FOLD = chr(0xFFFF)


def is_key_line(raw: Column) -> Column:
    return raw.rlike(KEY_LINE)


def _has_key(doc: str, with_message: bool) -> str:
    keys = [key for key in FIELDS.values() if with_message or key != "MESSAGE"]
    return "(" + " OR ".join(f"{value_at(doc, [key])} IS NOT NULL" for key in keys) + ")"


def _journald_object(text: Column, with_message: bool) -> Column:
    """Whether the text is a JSON object with a journal field; a null one counts."""

    def has_key(doc: Column) -> Column:
        found = F.lit(False)
        for key in FIELDS.values():
            if with_message or key != "MESSAGE":
                found = found | F.try_variant_get(doc, f"$['{key}']", "variant").isNotNull()
        return found

    return F.coalesce(let(json_object(text), has_key), F.lit(False))


def is_journald(raw: Column) -> Column:
    """One line of an export, as the detector sees it."""
    return is_key_line(raw) | _journald_object(raw, with_message=False)


def assemble_journald(lines: DataFrame, strict_blocks: bool = False, stored: bool = False) -> DataFrame:
    """Lines (file, block, line_no or pos, raw) to records (file, line_no, raw).

    A record ends at a blank line, and before a line that is neither indented
    nor one of the known keys. ``strict_blocks`` ends records at blank lines
    only. A file with any line that opens a JSON object is one record per line.
    ``stored`` says that ``lines`` are a written table already.
    """
    raw = F.col("raw")
    blank = ~has_text(raw)
    per_file = W.partitionBy("file")
    fresh = "pos" in lines.columns  # straight from a scan: numbered by the same look at the blocks
    order = "pos" if fresh else "line_no"
    sums, facts = numbering() if fresh else ([], {})
    sums = [*sums, F.max_by(blank, order).alias("_ends_blank"), F.bool_or(raw.rlike(rf"^{WS}*\{{")).alias("_brace")]
    facts = {
        **facts,
        "_after_blank": F.coalesce(F.lag("_ends_blank").over(per_file.orderBy("block")), F.lit(True)),
        "_json": F.bool_or("_brace").over(per_file),
    }
    known = with_block_facts(lines, sums, facts, stored)
    known = numbered(known) if fresh else known
    in_block = W.partitionBy("file", "block").orderBy("line_no")
    boundary = F.coalesce(F.lag(blank).over(in_block), F.col("_after_blank"))
    if not strict_blocks:
        boundary = boundary | ~(is_key_line(raw) | starts_indented(raw))
    flagged = (
        known.withColumn("_start", F.col("_json") | boundary)
        .filter(has_text(raw))
        .select("file", "block", "line_no", "raw", "_start")
    )
    return join_runs(flagged, "line_no", "raw", "_start", "\n")


# A record that needs no folding: no line is indented or blank.
_PLAIN = rf"\A(?!{INLINE_WS}|\n)[^\n]++(?:\n(?!{INLINE_WS}|\n|\z)[^\n]++)*+\z"
# A line that should name a key and has no '='. After an empty key nothing can be continued, so the next names one too.
_PART = f"[^=\\n{_FOLD}]*+(?:[\\n{_FOLD}]|\\z)"
_UNNAMED = f"(?:\\A|\\n)(?:{_PART}|=[^\\n{_FOLD}]*+{_FOLD}{_PART})"


def _folded(record: Column) -> Column:
    """The key lines of a record, continuation lines folded into their value."""
    text = F.regexp_replace(record, rf"\n{INLINE_WS}*(?=\n|\z)", "")
    text = F.regexp_replace(text, rf"^(?:{INLINE_WS}*\n)+", "")
    return F.when(matches(record, _PLAIN), record).otherwise(F.regexp_replace(text, rf"\n{INLINE_WS}+", _FOLD))


def _all_named(text: Column) -> Column:
    """Whether every line that should name a key has a '='."""
    return ~text.rlike(_UNNAMED)


def is_key_record(raw: Column) -> Column:
    return _all_named(_folded(raw))


def _opens_json(raw: Column) -> Column:
    return raw.rlike(rf"^{WS}*\{{")


def is_journald_record(raw: Column) -> Column:
    as_json = _journald_object(trim(raw), with_message=True)
    return has_text(raw) & F.when(_opens_json(raw), as_json).otherwise(is_key_record(raw))


def _integer_text(value: str) -> str:
    return bind(
        value,
        "v",
        bind(
            "schema_of_variant(v)",
            "k",
            f"""CASE WHEN {is_number("k")} THEN string(try_variant_get(v, '$', 'bigint'))
                WHEN k = 'STRING' THEN try_variant_get(v, '$', 'string') END""",
        ),
    )


def parse_journald(records: DataFrame) -> DataFrame:
    """Records, either one JSON object or ``KEY=value`` lines, as the journald columns."""
    raw = F.col("raw")
    split = records.withColumns(
        {
            "_doc": F.when(_opens_json(raw), json_object(trim(raw))),
            "_text": F.when(has_text(raw) & ~_opens_json(raw), _folded(raw)),
        }
    )
    # Only whether a record is kept stands behind the generator; fields that nobody asks for are never made.
    keeps = F.coalesce(F.expr(_has_key("_doc", with_message=True)), F.lit(False)) | F.coalesce(_all_named(F.col("_text")), F.lit(False))
    kept = with_present(split, "_kept", F.when(keeps, F.struct("_doc", "_text"))).drop("_doc", "_text")
    text = F.concat(F.lit("\n"), F.col("_kept._text"))

    def member(column: str, key: str) -> Column:
        found = value_at("_kept._doc", [key])
        return F.expr(_integer_text(found) if column in ("pid", "priority") else any_text(found))

    def after_key(name: str) -> Column:
        """The text after the last ``name=`` line; continuation lines lose their indent."""
        last = F.substring_index(F.substring_index(text, f"\n{name}=", -1), "\n", 1)
        return F.when(F.contains(text, F.lit(f"\n{name}=")), F.translate(last, _FOLD, "\n"))

    is_text = F.col("_kept._text").isNotNull()
    value = {column: F.when(is_text, after_key(key)).otherwise(member(column, key)) for column, key in FIELDS.items()}
    kept = kept.withColumn("_ms", epoch_millis(value["timestamp"]))
    return project(
        kept,
        [
            ("timestamp", iso_text(F.col("_ms"))),
            ("priority", lenient_int(value["priority"])),
            ("unit", value["unit"]),
            ("hostname", value["hostname"]),
            ("identifier", value["identifier"]),
            ("pid", lenient_int(value["pid"])),
            ("message", value["message"]),
        ],
    )
