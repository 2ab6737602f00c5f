"""Severity words in free text and their rank."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A level is the first row with a word contained in the lower-cased line.
LEVEL_WORDS = [
    ("fatal", ["fatal", "crit", "critical", "emergency"]),
    ("critical", ["critical", "crit"]),
    ("error", ["error", "err", "fail", "failed", "exception"]),
    ("warning", ["warning", "warn"]),
    ("notice", ["notice"]),
    ("info", ["info", "information"]),
    ("debug", ["debug", "dbg"]),
    ("trace", ["trace", "verbose"]),
]
LEVEL_RANK = ["fatal", "critical", "error", "warning", "notice", "info", "debug", "trace", "unknown"]


def _shortest(words: list[str]) -> list[str]:
    """A word that contains another of the same level adds nothing."""
    return [w for w in words if not any(o != w and o in w for o in words)]


def classify_level(line: Column) -> Column:
    text = F.lower(line)
    level, taken = F, set()
    for name, words in LEVEL_WORDS:
        wanted = [w for w in _shortest(words) if w not in taken]
        taken.update(wanted)
        if wanted:
            hit = F.contains(text, F.lit(wanted[0]))
            for word in wanted[1:]:
                hit = hit | F.contains(text, F.lit(word))
            level = level.when(hit, name)
    # Words such as [ERR] or "warn" were found above; only the one-letter tags are left.
    return (
        level.when(F.contains(line, F.lit("[E]")), "error")
        .when(F.contains(line, F.lit("[W]")), "warning")
        .otherwise("info")
    )


def level_rank(level: Column) -> Column:
    """0 for fatal up to 7 for trace and 8 for unknown; NULL for any other text."""
    rank = F.array_position(F.array(*[F.lit(name) for name in LEVEL_RANK]), level) - 1
    return F.when(rank >= 0, rank.cast("int"))
