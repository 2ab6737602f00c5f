"""Shape shared by all parse jobs: which columns pass through and which are made."""

from pyspark.sql import Column, DataFrame


def passthrough(lines: DataFrame) -> list[str]:
    """``file`` where the input has one, then the base columns."""
    return [name for name in ("file", "line_no", "raw") if name in lines.columns]


def project(lines: DataFrame, fields: list[tuple[str, Column]]) -> DataFrame:
    """The table layout: base columns first, a repeated name kept once (the first wins)."""
    kept = passthrough(lines)
    columns, seen = [lines[name] for name in kept], set(kept)
    for name, column in fields:
        if name not in seen:
            seen.add(name)
            columns.append(column.alias(name))
    return lines.select(*columns)
