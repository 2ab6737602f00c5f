"""Plain text lines: every line is a row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.levels import classify_level
from timberline.functions.once import with_once
from timberline.functions.times import best_effort_millis, iso_text, time_candidate
from timberline.operators.frame import project


def parse_generic(lines: DataFrame, ref_time: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if ref_time is None else ref_time
    raw = F.col("raw")
    timed = with_once(lines, "_t", time_candidate(raw))
    return project(
        timed,
        [("timestamp", iso_text(best_effort_millis(F.col("_t"), now))), ("level", classify_level(raw)), ("message", raw)],
    )
