"""SQLite function names that Spark SQL lacks, as temporary SQL functions.

Functions of a time take up to five modifiers, which are folded over it one by one.
They are expanded into built-in expressions when a query is analysed. What has
another spelling in Spark SQL is listed in the README.
"""

from pyspark.sql import SparkSession

# The date codes of strftime and what stands for them, of time t.
DATE_CODES = {
    "%Y": "date_format(t, 'yyyy')",
    "%m": "date_format(t, 'MM')",
    "%d": "date_format(t, 'dd')",
    "%H": "date_format(t, 'HH')",
    "%M": "date_format(t, 'mm')",
    "%S": "date_format(t, 'ss')",
    "%f": "date_format(t, 'ss.SSS')",
    "%j": "date_format(t, 'DDD')",
    "%s": "cast(unix_seconds(t) AS STRING)",
    "%w": "cast(dayofweek(t) - 1 AS STRING)",
    "%%": "'%'",
}

# What a modifier m makes of the time t, in UTC. A month or year that has no such day runs on into the next.
_SHIFT = "timestampadd(MICROSECOND, cast(round({amount} * {micros}) AS BIGINT), t)"
_NUMBER = r"try_cast(regexp_extract(m, r'^([+-]?\d+(?:\.\d+)?)', 1) AS DOUBLE)"
_UNIT = r"^[+-]?\d+(?:\.\d+)? *{0}s?$"
# The units of a span, in microseconds; what part of a month or year is over counts as 30 or 365 days.
_SPANS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
_MONTHS = {"month": (1, 30), "year": (12, 365)}


def _months(months: int, days: int) -> str:
    whole = f"cast({_NUMBER} AS INT)"
    rest = f"({_NUMBER} - {whole}) * {days}"
    day = f"date_add(add_months(trunc(t, 'MONTH'), {whole} * {months}), dayofmonth(t) - 1)"
    moved = f"timestampadd(MICROSECOND, unix_micros(t) - unix_micros(date_trunc('DAY', t)), cast({day} AS TIMESTAMP))"
    return f"timestampadd(MICROSECOND, cast(round({rest} * 86400000000) AS BIGINT), {moved})"


_CLOCK = r"^[+-](?:[01]\d|2[0-4]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?$"
_CLOCK_SECONDS = r"""(if(startswith(m, '-'), -1, 1) * (cast(substr(m, 2, 2) AS INT) * 3600 + cast(substr(m, 5, 2) AS INT) * 60
    + coalesce(try_cast(substr(m, 8) AS DOUBLE), 0)))"""
_STEP = f"""CASE
    WHEN m IN ('utc', 'localtime', 'unixepoch', 'julianday', 'auto') THEN t
    WHEN m IN ('start of day', 'start of month', 'start of year') THEN date_trunc(substr(m, 10), t)
    WHEN m RLIKE '^weekday [0-6]$' THEN timestampadd(DAY, pmod(cast(right(m, 1) AS INT) - dayofweek(t) + 1, 7), t)
    {" ".join(f"WHEN m RLIKE r'{_UNIT.format(unit)}' THEN {_SHIFT.format(amount=_NUMBER, micros=micros)}" for unit, micros in _SPANS.items())}
    {" ".join(f"WHEN m RLIKE r'{_UNIT.format(unit)}' THEN {_months(*size)}" for unit, size in _MONTHS.items())}
    WHEN m RLIKE r'{_CLOCK}' THEN {_SHIFT.format(amount=_CLOCK_SECONDS, micros=1_000_000)} END"""
# A number is a Julian day, or with the first modifier 'unixepoch' seconds; a time of day alone is one of the year 2000.
_NUMERIC = "try_cast(x AS DOUBLE)"
_JULIAN = f"timestamp_micros(cast(round(({_NUMERIC} - 2440587.5D) * 86400000000) AS BIGINT))"
_EPOCH = f"timestamp_micros(cast(round({_NUMERIC} * 1000000) AS BIGINT))"
# The Julian days and the seconds of the years 0 (with those before it as days) to 9999.
_IS_JULIAN, _IS_EPOCH = f"{_NUMERIC} BETWEEN 0 AND 5373484.499999", f"{_NUMERIC} BETWEEN -62167219200 AND 253402300799"
_START = rf"""CASE
    WHEN x RLIKE r'^[+-]?\d+(?:\.\d+)?$' THEN CASE
        WHEN lower(m1) = 'unixepoch' OR lower(m1) = 'auto' AND NOT {_IS_JULIAN} THEN if({_IS_EPOCH}, {_EPOCH}, NULL)
        WHEN {_IS_JULIAN} THEN {_JULIAN} END
    WHEN lower(m1) IN ('unixepoch', 'julianday') THEN NULL
    WHEN x = 'now' THEN current_timestamp()
    WHEN x RLIKE r'^\d\d:\d\d' THEN try_cast(concat('2000-01-01 ', x) AS TIMESTAMP)
    ELSE try_cast(x AS TIMESTAMP) END"""
_PLACES = [f"m{n}" for n in range(1, 6)]
_MODIFIERS = "".join(f", {m} STRING DEFAULT ''" for m in _PLACES)
# An empty modifier is one that is not given; NULL makes the time NULL.
_MOMENT = f"""reduce(transform(filter(array({", ".join(_PLACES)}), m -> m IS NULL OR m <> ''), m -> lower(trim(m))), {_START},
    (t, m) -> {_STEP})"""

# Each code is a piece of its own and all else is kept as it is; an unknown code gives NULL.
_CODES = " ".join(f"WHEN p = '{code}' THEN {text}" for code, text in DATE_CODES.items())
_STRFTIME = rf"""transform(array({_MOMENT}), t -> if(t IS NULL, NULL, reduce(
    transform(regexp_extract_all(f, r'(?s)%.|[^%]+|%\z', 0),
              p -> CASE {_CODES} WHEN startswith(p, '%') THEN NULL ELSE p END),
    '', (a, p) -> concat(a, p))))[0]"""

# The pieces of a GLOB pattern: a class, a run of anything, any one character, or a character as it is.
_PIECES = r"(?s)\[\^?\]?[^\]]*\]|."
_CLASS = r"""concat('[', regexp_replace(substring(g, 2, length(g) - 2), r'([\\\[\]&])', r'\\$1'), ']')"""
_GLOB = rf"""concat('^', array_join(transform(regexp_extract_all(p, r'{_PIECES}', 0), g -> CASE
    WHEN g = '*' THEN '(?s:.*)' WHEN g = '?' THEN '(?s:.)' WHEN length(g) > 1 THEN {_CLASS}
    ELSE concat(r'\Q', g, r'\E') END), ''), r'\z')"""

# The names of the types of JSON values.
_TYPE = """transform(array(schema_of_variant(try_parse_json(x))), k -> CASE
    WHEN k = 'VOID' THEN 'null' WHEN k = 'BOOLEAN' THEN if(try_variant_get(try_parse_json(x), '$', 'boolean'), 'true', 'false')
    WHEN k = 'BIGINT' THEN 'integer' WHEN k = 'DOUBLE' OR startswith(k, 'DECIMAL') THEN 'real' WHEN k = 'STRING' THEN 'text'
    WHEN startswith(k, 'ARRAY') THEN 'array' WHEN startswith(k, 'OBJECT') THEN 'object' END)[0]"""

FUNCTIONS = {
    "unicode": ("x STRING", "INT", "ascii(x)"),
    "unixepoch": (f"x STRING{_MODIFIERS}", "BIGINT", f"unix_seconds({_MOMENT})"),
    "julianday": (f"x STRING{_MODIFIERS}", "DOUBLE", f"unix_micros({_MOMENT}) / 86400000000D + 2440587.5D"),
    "datetime": (f"x STRING{_MODIFIERS}", "STRING", f"date_format({_MOMENT}, 'yyyy-MM-dd HH:mm:ss')"),
    "date_of": (f"x STRING{_MODIFIERS}", "STRING", f"date_format({_MOMENT}, 'yyyy-MM-dd')"),
    "time_of": (f"x STRING{_MODIFIERS}", "STRING", f"date_format({_MOMENT}, 'HH:mm:ss')"),
    "strftime": (f"f STRING, x STRING{_MODIFIERS}", "STRING", _STRFTIME),
    "glob": ("p STRING, x STRING", "BOOLEAN", f"x RLIKE {_GLOB}"),
    "json_extract": ("x STRING, p STRING", "STRING", "get_json_object(x, p)"),
    # The parser stops after the first value; inside an array and an object alike nothing else may follow it.
    "json_valid": (
        "x STRING",
        "BOOLEAN",
        """x IS NOT NULL AND try_parse_json(x) IS NOT NULL AND try_parse_json(concat('{"k":', x, '}')) IS NOT NULL
           AND try_variant_get(try_parse_json(concat('[', x, ']')), '$[0]', 'variant') IS NOT NULL
           AND try_variant_get(try_parse_json(concat('[', x, ']')), '$[1]', 'variant') IS NULL""",
    ),
    "json_type": ("x STRING", "STRING", _TYPE),
}


def register_functions(spark: SparkSession) -> None:
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
