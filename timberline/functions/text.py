"""Whitespace, number and capture helpers shared by all line grammars.

Java's ``\\s`` is ASCII only and its ``$`` also matches before a last newline,
so patterns here spell out the whitespace class and end with ``\\z``.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates log fields.
SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = rf"[\s{SPACES}]"
NON_WS = rf"[^\s{SPACES}]"
INLINE_WS = rf"[\t\x0B\f\r {SPACES}]"
ANY = r"[^\n\r\x{2028}\x{2029}]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _ascii_form(pattern: str) -> str:
    for wide, narrow in [(NON_WS, r"\S"), (WS, r"\s"), (ANY, r"[^\n\r]"), (SPACES, "")]:
        pattern = pattern.replace(wide, narrow)
    return pattern


def _by_width(text: Column, pattern: str, apply: Callable[[str], Column]) -> Column:
    """``apply`` with a pattern of plain classes, several times faster, where the text is ASCII."""
    narrow = _ascii_form(pattern)
    return apply(pattern) if narrow == pattern else F.when(is_ascii(text), apply(narrow)).otherwise(apply(pattern))


def matches(text: Column, pattern: str) -> Column:
    return _by_width(text, pattern, lambda p: text.rlike(p))


def trim(text: Column) -> Column:
    ascii_trim = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(is_ascii(text), ascii_trim).otherwise(F.regexp_replace(text, rf"^{WS}+|{WS}+\z", ""))


def has_text(line: Column) -> Column:
    return line.rlike(NON_WS)


def starts_indented(line: Column) -> Column:
    return line.rlike(rf"^{WS}")


def capture(line: Column, pattern: str, groups: list[int]) -> Column:
    """The groups of a whole-line ``pattern`` as an array, found in one regex run.

    A line holds no newline, so the newline is free to separate the pieces. An
    optional group that did not take part gives ''; a line that does not match is
    left as it is, one piece.
    """
    pieces = "\n".join(f"${g}" for g in groups)
    return F.split(_by_width(line, pattern, lambda p: F.regexp_replace(line, p, pieces)), "\n")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def dash_to_null(text: Column) -> Column:
    return F.when(~text.isin("", "-"), text)


def lenient_int(text: Column) -> Column:
    """Leading digits of a text as BIGINT; NULL when there are none."""
    return F.regexp_extract(text, rf"^{WS}*([+-]?\d+)", 1).try_cast("bigint")


def glob_match(text: Column, pattern: str) -> Column:
    """SQLite GLOB: case-sensitive, ``*`` any run, ``?`` one character, ``[...]`` a class."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        # A ']' that comes first, after '^' too, is a member of the class.
        close = pattern.find("]", i + (3 if pattern.startswith("[^", i) else 2)) if char == "[" else -1
        if close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&&", "&\\&")
            out.append(f"[{body}]")
            i = close + 1
            continue
        out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(char) or f"\\Q{char}\\E")
        i += 1
    return text.rlike("^" + "".join(out) + r"\z")
