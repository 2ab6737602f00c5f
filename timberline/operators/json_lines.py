"""JSON lines: flatten, infer a schema over every record, project to columns."""

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.json_text import (
    bind,
    is_number,
    json_object,
    json_objects,
    kind_name,
    kind_of,
    leaf_text,
    literal,
    number_text,
    text_of,
    value_at,
)
from timberline.functions.keys import column_order, sanitize_key, sanitized
from timberline.functions.text import trim
from timberline.operators.frame import project

# Keys that fill the promoted columns, in order of preference.
TIMESTAMP_KEYS = ["@timestamp", "timestamp", "time", "ts"]
LEVEL_KEYS = ["level", "severity", "lvl"]
MESSAGE_KEYS = ["message", "msg"]
PROMOTED = {"timestamp": TIMESTAMP_KEYS, "level": LEVEL_KEYS, "message": MESSAGE_KEYS}
ALIASES = sorted({sanitized([key]) for keys in PROMOTED.values() for key in keys})

# What the values of a path can be; float is any number not written as an integer.
KINDS = ["string", "array", "empty", "boolean", "number", "float", "fraction"]
MAX_COLUMNS = 2000
_FIRST_DEPTH = 4


def is_json(raw: Column) -> Column:
    return json_object(raw).isNotNull()


def is_json_line(raw: Column) -> Column:
    """As the detector sees it: any white space around the object is fine."""
    return is_json(trim(raw))


# ---------------------------------------------------------------- flatten


def _leaves(lines: DataFrame, depth: int) -> DataFrame:
    """One row per leaf after opening ``depth`` levels of objects."""
    keep = [name for name in ("file", "line_no") if name in lines.columns]
    objects = json_objects(lines.select(*keep, "raw"))
    level = objects.select(*keep, F.array().cast("array<string>").alias("path"), F.col("_doc").alias("val"))
    for n in range(depth):
        members = F.try_variant_get("val", "$", "map<string,variant>")
        opened = level.select(*keep, "path", "val", F.explode_outer(members).alias("_key", "_member"))
        if n == 0:
            opened = opened.filter(F.col("_key").isNotNull())
        level = opened.select(
            *keep,
            F.when(F.col("_key").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("_key"))).alias("path"),
            F.when(F.col("_key").isNull(), F.col("val")).otherwise(F.col("_member")).alias("val"),
        )
    return level


def _with_kind(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("type", F.schema_of_variant("val")).withColumn("kind", F.expr(kind_name("type")))


def flatten_json(lines: DataFrame) -> DataFrame:
    """(file, line_no, key, value, kind): one row per leaf, keyed by its column name.

    Opens as many levels as the data has; a second look is needed only for
    objects nested deeper than the first guess.
    """
    depth = nesting(lines)
    leaves = _with_kind(_leaves(lines, depth))
    keep = [name for name in ("file", "line_no") if name in lines.columns]
    return leaves.select(
        *keep,
        sanitize_key(F.array_join("path", "_")).alias("key"),
        F.expr(text_of("val", "type")).alias("value"),
        F.when(F.col("kind") == "empty", "object").otherwise(F.col("kind")).alias("kind"),
    )


def nesting(lines: DataFrame) -> int:
    """A number of object levels that opens every leaf."""
    braces = F.length("raw") - F.length(F.replace(F.col("raw"), F.lit("{"), F.lit("")))
    most = lines.agg(F.max(braces)).first()[0] or 0
    depth = min(most, _FIRST_DEPTH)
    while depth < most and not _with_kind(_leaves(lines, depth)).filter("kind = 'object'").isEmpty():
        depth = min(most, 2 * depth)
    return max(depth, 1)


# ------------------------------------------------------------ infer schema


@dataclass
class JsonColumn:
    """A column and where its values come from."""

    name: str
    type: str
    paths: list[list[str]] = field(default_factory=list)
    kinds: set[str] = field(default_factory=set)
    huge: bool = False
    nested: bool = False


@dataclass
class JsonColumns:
    """``columns`` in table order, and the paths whose names fill promoted columns.

    ``wide`` says that there are too many columns for a table: ``columns`` is then
    empty, and each record is kept whole in a VARIANT column named ``fields``.
    """

    columns: list[JsonColumn]
    aliases: dict[str, JsonColumn]
    wide: bool = False


def _path_kinds(lines: DataFrame, depth: int) -> DataFrame:
    """What the values of each path are, folded to a few rows per path before the shuffle."""
    number = F.when((F.col("kind") == "number") & (F.col("type") != "BIGINT"), F.try_variant_get("val", "$", "double"))
    kinds = (
        _with_kind(_leaves(lines, depth))
        .select(
            "path",
            "kind",
            number.isNotNull().alias("float"),
            (F.coalesce(number, F.lit(0.0)) != F.floor(F.coalesce(number, F.lit(0.0)))).alias("fraction"),
            (F.abs(F.coalesce(number, F.lit(0.0))) >= 2.0**63).alias("huge"),
        )
        .groupBy("path", "kind", "float", "fraction", "huge")
        .count()
    )
    return kinds.groupBy("path").agg(
        *[F.bool_or(F.col("kind") == k).alias(k) for k in ("string", "array", "empty", "object", "boolean", "number")],
        *[F.bool_or(flag).alias(flag) for flag in ("float", "fraction", "huge")],
    )


def infer_json_schema(lines: DataFrame) -> DataFrame:
    """(name, type) of the inferred columns, over every record, in table order."""
    return _name_types(_path_kinds(lines, nesting(lines)))


def _name_types(paths: DataFrame) -> DataFrame:
    text = F.bool_or(F.col("string") | F.col("array") | F.col("empty"))
    some = F.bool_or(F.col("number") | F.col("boolean"))
    return (
        paths.filter(~F.col("object"))
        .groupBy(sanitize_key(F.array_join("path", "_")).alias("name"))
        .agg(
            F.when(text | ~some, "TEXT").when(F.bool_or("fraction"), "REAL").otherwise("INTEGER").alias("type")
        )
        .filter(~F.col("name").isin(*ALIASES))
        .orderBy(F.translate("name", "_", " "))
    )


def discover_columns(lines: DataFrame, max_columns: int = MAX_COLUMNS) -> JsonColumns:
    """The inferred columns with their paths; only the distinct paths reach the driver.

    Of records with more than ``max_columns`` columns only the promoted ones are
    made, and the rest of each record stays in one column.
    """
    depth = _FIRST_DEPTH
    while True:
        paths = _path_kinds(lines, depth)
        # The filter keeps the limit off the top of the plan, where it would run partition by partition.
        rows = paths.limit(4 * max_columns + 1).filter(F.col("path").isNotNull()).collect()
        if not any(row["object"] for row in rows):
            break
        depth *= 2
    wide = len(rows) > 4 * max_columns
    found = _columns_of(rows)
    dynamic = sorted((c for n, c in found.items() if n not in ALIASES), key=lambda c: column_order(c.name))
    if wide or len(dynamic) > max_columns:
        # Whatever the number of paths, those that fill a promoted column have one of a few names.
        name = sanitize_key(F.array_join("path", "_"))
        found, dynamic, wide = _columns_of(paths.filter(name.isin(*ALIASES)).collect()), [], True
    return JsonColumns(dynamic, {name: found[name] for name in ALIASES if name in found}, wide)


def _columns_of(rows: list) -> dict[str, JsonColumn]:
    """Columns by name, from the kinds of the values of each path."""
    opened = {tuple(row["path"][:n]) for row in rows for n in range(1, len(row["path"]))}
    found: dict[str, JsonColumn] = {}
    for row in sorted(rows, key=lambda row: row["path"]):
        name = sanitized(row["path"])
        column = found.setdefault(name, JsonColumn(name, "TEXT"))
        column.paths.append(list(row["path"]))
        column.kinds |= {k for k in KINDS if row[k]}
        column.huge |= row["huge"]
        column.nested |= tuple(row["path"]) in opened
    for column in found.values():
        if column.kinds & {"string", "array", "empty"} or not column.kinds:
            column.type = "TEXT"
        else:
            column.type = "REAL" if "fraction" in column.kinds or column.huge else "INTEGER"
    return found


# ----------------------------------------------------------------- project


def _json_path(path: list[str]) -> str:
    return literal("$" + "".join(f"['{key}']" for key in path))


def _key_position(path: list[str], depth: int) -> str:
    """Where the key at ``depth`` of ``path`` stands among its siblings in the line."""
    inside = "raw" if depth == 0 else f"get_json_object(raw, {_json_path(path[:depth])})"
    return f"array_position(json_object_keys({inside}), {literal(path[depth])})"


def _of_latest(paths: list[list[str]], made: Callable[[list[str]], str]) -> str:
    """What is ``made`` of whichever path comes last in the text of the line."""
    if len(paths) == 1:
        return made(paths[0])
    candidates = []
    for n, path in enumerate(paths):
        # A non-empty object is no leaf: its members have columns of their own.
        leaf = f"coalesce({kind_of(value_at('_doc', path))} <> 'object', false)"
        places = ", ".join(_key_position(path, depth) for depth in range(len(path)))
        candidates.append(f"named_struct('at', CASE WHEN {leaf} THEN array({places}) END, 'n', {n})")
    picks = " ".join(f"WHEN c.at IS NOT NULL AND c.n = {n} THEN {made(path)}" for n, path in enumerate(paths))
    return bind(f"array_max(array({', '.join(candidates)}))", "c", f"CASE {picks} END")


def _latest(paths: list[list[str]]) -> str:
    return _of_latest(paths, lambda path: value_at("_doc", path))


def _array_text(path: list[str]) -> str:
    """An array as JSON; where it holds objects, as written, since VARIANT sorts their keys."""
    if any("'" in key for key in path):
        return "to_json(a)"
    written = f"get_json_object(raw, {_json_path(path)})"
    return f"CASE WHEN contains(to_json(a), '{{') THEN coalesce({written}, to_json(a)) ELSE to_json(a) END"


def _leaf_or_array(path: list[str]) -> str:
    is_array = "startswith(schema_of_variant(a), 'ARRAY')"
    text = f"CASE WHEN {is_array} THEN {_array_text(path)} ELSE {leaf_text('a')} END"
    return bind(value_at("_doc", path), "a", text)


def _cell(column: JsonColumn) -> str:
    """The SQL of a column: one typed lookup where all its values are alike."""
    kinds, path = column.kinds, column.paths[0]
    alone = len(column.paths) == 1 and not column.nested
    if column.type != "TEXT":
        target = "bigint" if column.type == "INTEGER" else "double"
        if len(column.paths) == 1 and "boolean" not in kinds:
            return value_at("_doc", path, target)
        if alone and kinds == {"boolean"}:
            return f"cast(int({value_at('_doc', path, 'boolean')}) AS {target})"
        flag = f"cast(int(try_variant_get(v, '$', 'boolean')) AS {target})"
        number = f"try_variant_get(v, '$', '{target}')"
        return bind(
            _latest(column.paths), "v", f"CASE WHEN schema_of_variant(v) = 'BOOLEAN' THEN {flag} ELSE {number} END"
        )
    if alone and kinds <= {"string", "number"}:
        return value_at("_doc", path, "string")
    return _of_latest(column.paths, _leaf_or_array) if "array" in kinds else leaf_text(_latest(column.paths))


def _promote(target: str, aliases: dict[str, JsonColumn]) -> str:
    """The first top-level alias holding a text or a number, else the first among the flattened names.

    An alias holding null ends the first search; booleans and nested values are
    passed over. A message is never made of a boolean or a number in the second.
    """
    keys = PROMOTED[target]
    names = [name for name in dict.fromkeys(sanitized([key]) for key in keys) if name in aliases]
    present = [key for key in keys if any([key] in aliases[name].paths for name in names)]
    columns = [replace(aliases[name], type="TEXT") for name in names if aliases[name].kinds]
    plain = {"string"} if target == "message" else {"string", "number", "float", "fraction"}
    if all(len(c.paths) == 1 and c.paths[0][0] in keys and not c.nested and c.kinds <= plain for c in columns):
        # Nothing to pass over, so both searches find the same.
        options = [_cell(c) for c in columns]
        return f"coalesce({', '.join(options)})" if options else "cast(NULL AS string)"
    picked = "cast(NULL AS string)"
    for n, key in reversed(list(enumerate(present))):
        picked = bind(
            value_at("_doc", [key]),
            f"p{n}",
            f"""CASE WHEN schema_of_variant(p{n}) = 'STRING' THEN try_variant_get(p{n}, '$', 'string')
                WHEN {is_number(f"schema_of_variant(p{n})")} THEN {number_text(f"p{n}")}
                WHEN schema_of_variant(p{n}) = 'VOID' THEN NULL ELSE {picked} END""",
        )
    options = [picked]
    for column in columns:
        text = _cell(column)
        if target == "message" and column.kinds & {"number", "boolean"}:
            text = f"CASE WHEN {kind_of(_latest(column.paths))} IN ('string', 'array', 'empty') THEN {text} END"
        options.append(text)
    return f"coalesce({', '.join(options)})"


def parse_json(lines: DataFrame, columns: JsonColumns | None = None) -> DataFrame:
    """One row per JSON object, with the promoted and the inferred columns."""
    known = columns or discover_columns(lines)
    fields = [(target, F.expr(_promote(target, known.aliases))) for target in PROMOTED]
    fields += [(column.name, F.expr(_cell(column))) for column in known.columns]
    fields += [("fields", F.col("_doc"))] if known.wide else []
    return project(json_objects(lines), fields)
