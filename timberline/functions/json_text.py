"""JSON objects as VARIANT columns, and values in them as text and numbers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.once import let, with_present

_BLANK = r"[ \t\n\r]*"


def _wrapped(raw: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))


def _only_object(raw: Column, wrapped: Column) -> Column:
    """The object in ``[raw]``; NULL if ``raw`` is not exactly one JSON object.

    The parser stops after the first value and ignores what follows. Inside an
    array only a comma or ']' may follow the object, inside an object only a
    comma or '}', so text that parses in both wrappers has nothing after it.
    """
    inner = F.try_parse_json(F.concat(F.lit('{"k":'), raw, F.lit("}")))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    ended = ~raw.rlike(rf"\}}{_BLANK}\]") | inner.isNotNull()
    return F.when(opens_object(raw) & alone & ended, F.try_variant_get(wrapped, "$[0]", "variant"))


def opens_object(raw: Column) -> Column:
    return raw.rlike(rf"^{_BLANK}\{{")


def json_object(raw: Column) -> Column:
    """The text as a VARIANT object; NULL for anything that is not exactly one JSON object."""
    return let(F.when(opens_object(raw), _wrapped(raw)), lambda wrapped: _only_object(raw, wrapped))


def json_objects(lines: DataFrame) -> DataFrame:
    """The lines that are JSON objects, with the object as ``_doc``; each is parsed once."""
    parsed = lines.withColumn("_w", F.when(opens_object(F.col("raw")), _wrapped(F.col("raw"))))
    return with_present(parsed, "_doc", _only_object(F.col("raw"), F.col("_w"))).drop("_w")


# The rest of this module is SQL text: a projection of hundreds of inferred
# columns is then one parse instead of a call per operator.


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """``body``, in which ``name`` stands for ``value`` computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _segment(key: str) -> str | None:
    if "'" not in key:
        return f"['{key}']"
    return f'["{key}"]' if '"' not in key else None


def value_at(doc: str, path: list[str], kind: str = "variant") -> str:
    """The value under ``path``, NULL where absent."""
    steps, value = "$", doc
    for key in path:
        segment = _segment(key)
        if segment is None:
            members = f"try_variant_get({value}, {literal(steps)}, 'map<string,variant>')"
            value, steps = f"try_element_at({members}, {literal(key)})", "$"
        else:
            steps += segment
    return f"try_variant_get({value}, {literal(steps)}, '{kind}')"


def is_number(name: str) -> str:
    return f"({name} IN ('BIGINT', 'DOUBLE') OR startswith({name}, 'DECIMAL'))"


def kind_name(t: str) -> str:
    """string, number, boolean, null, array, empty ({}) or object, from the type of a VARIANT."""
    return f"""CASE WHEN {t} = 'STRING' THEN 'string' WHEN {is_number(t)} THEN 'number' WHEN {t} = 'BOOLEAN' THEN 'boolean'
        WHEN {t} = 'VOID' THEN 'null' WHEN startswith({t}, 'ARRAY') THEN 'array' WHEN {t} = 'OBJECT<>' THEN 'empty'
        WHEN startswith({t}, 'OBJECT') THEN 'object' END"""


def kind_of(value: str) -> str:
    return bind(f"schema_of_variant({value})", "t", kind_name("t"))


# A double as decimal text: no '.0' on whole numbers, exponents only outside 1e-6..1e21.
_DOUBLE_TEXT = r"""CASE WHEN d = 0 THEN '0'
    WHEN NOT contains(string(d), 'E') THEN regexp_replace(string(d), r'\.0$', '')
    WHEN abs(d) >= 1e21D OR abs(d) < 1e-6D
        THEN replace(regexp_replace(replace(string(d), '.0E', 'E'), r'E(\d)', 'e+$1'), 'E', 'e')
    WHEN abs(d) < 1 THEN regexp_replace(string(cast(d AS decimal(38, 30))), r'\.?0+$', '')
    ELSE regexp_replace(string(cast(d AS decimal(38, 16))), r'\.?0+$', '') END"""


def double_text(number: str) -> str:
    return bind(number, "d", _DOUBLE_TEXT)


def number_text(v: str) -> str:
    """A VARIANT number as text; whole numbers keep all their digits."""
    whole = f"string(try_variant_get({v}, '$', 'bigint'))"
    exact = f"try_variant_get({v}, '$', 'double')"
    return bind(exact, "n", f"CASE WHEN n = floor(n) AND abs(n) < 1e18D THEN {whole} ELSE {double_text('n')} END")


_FLAG = "string(int(try_variant_get({v}, '$', 'boolean')))"


def text_of(v: str, k: str, boolean: str = _FLAG, is_object: str = "{k} = 'OBJECT<>'") -> str:
    """The text of value ``v`` of type ``k``."""
    return f"""CASE WHEN {k} = 'STRING' THEN try_variant_get({v}, '$', 'string') WHEN {is_number(k)} THEN {number_text(v)}
        WHEN {k} = 'BOOLEAN' THEN {boolean.format(v=v)}
        WHEN startswith({k}, 'ARRAY') OR {is_object.format(k=k)} THEN to_json({v}) END"""


def leaf_text(value: str) -> str:
    """A leaf as text: booleans as 1/0, arrays and {} as JSON, JSON null and objects as NULL."""
    return bind(value, "v", bind("schema_of_variant(v)", "k", text_of("v", "k")))


def any_text(value: str) -> str:
    """Any value as text: booleans as true/false, arrays and objects as JSON."""
    boolean, is_object = "try_variant_get({v}, '$', 'string')", "startswith({k}, 'OBJECT')"
    return bind(value, "v", bind("schema_of_variant(v)", "k", text_of("v", "k", boolean, is_object)))
