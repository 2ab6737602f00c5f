import json

import pytest
from pyspark.sql import functions as F

from timberline.functions.json_text import double_text, json_object
from timberline.operators.json_lines import discover_columns, flatten_json, infer_json_schema, parse_json
from timberline.operators.results import table_info


def parsed(df):
    return [r.asDict() for r in parse_json(df).orderBy("line_no").collect()]


def test_promoted_and_plain(lines):
    row = parsed(lines('{"severity":"notice","msg":"door open","floor":4}'))[0]
    assert (row["level"], row["message"], row["floor"], row["timestamp"]) == ("notice", "door open", 4, None)


def test_arrays_objects_and_booleans(lines):
    rows = parsed(
        lines('{"rooms":["east",7],"beds":5,"o":{},"n":{"x":{"y":1.5}}}', '{"msg":null,"clean":true}', '{"t":[{"z":1,"a":2}]}')
    )
    assert rows[0]["rooms"] == '["east",7]' and rows[0]["beds"] == 5 and rows[0]["o"] == "{}" and rows[0]["n_x_y"] == 1.5
    assert rows[1]["message"] is None and rows[1]["clean"] == 1
    assert rows[2]["t"] == '[{"z":1,"a":2}]'


@pytest.mark.parametrize(
    "text",
    ["not-json", "", "[1]", "1", "null", '"x"', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}]', '{"a":1}] }',
     '{"a":1}}', "{'a':1}", '{"a":NaN}', '{"a":1,}', '{"a"}', '{"a":01}', chr(0xA0) + '{"a":1}'],
)
def test_not_an_object(spark, text):
    df = spark.createDataFrame([(text,)], "raw string")
    assert df.select(json_object(F.col("raw")).isNull()).first()[0]


@pytest.mark.parametrize("text", ['{"a":1}', ' \t{"a":[{"b":1}]} ', '{}', '{"a":"}] x"}', '{"a":[{"b":{}}] }', '{"a":1,"a":2}'])
def test_an_object(spark, text):
    df = spark.createDataFrame([(text,)], "raw string")
    assert df.select(json_object(F.col("raw")).isNotNull()).first()[0]


def test_types_cover_every_record(lines):
    texts = ['{"a":1,"b":1,"c":1.0,"d":null,"e":true,"f":1e2}'] * 150
    texts.append('{"a":"x","b":2.5,"late":1,"e":3,"f":[1]}')
    columns = {r["name"]: r["type"] for r in infer_json_schema(lines(*texts)).collect()}
    assert columns == {"a": "TEXT", "b": "REAL", "c": "INTEGER", "d": "TEXT", "e": "INTEGER", "f": "TEXT", "late": "INTEGER"}
    rows = parse_json(lines(*texts))
    assert rows.filter("late IS NOT NULL").count() == 1
    first = rows.orderBy("line_no").first()
    assert (first["a"], first["b"], first["c"], first["e"], first["f"]) == ("1", 1.0, 1, 1, "100")


def test_column_order_and_names(lines):
    df = parse_json(lines('{"b":1,"a1":1,"a_1":1,"line_no":1,"raw":2,"1x":1,"é":1,"A B":1,"--":2}'))
    assert df.columns == ["file", "line_no", "raw", "timestamp", "level", "message", "a_1", "a_b", "a1", "b", "field_1x",
                          "json_line_no", "json_raw", "value"]
    assert [r["type"] for r in table_info(df).orderBy("cid").collect()][:3] == ["TEXT", "INTEGER", "TEXT"]


def test_later_of_two_paths_with_one_name_wins(lines):
    rows = parsed(
        lines('{"a-b":1,"a_b":2}', '{"a_b":2,"a-b":1}', '{"a":{"b":3},"a_b":null}', '{"a_b":4,"a":{"b":5}}', '{"a":{"b":{"c":1}},"a-b":6}')
    )
    assert [r["a_b"] for r in rows] == [2, 1, None, 5, 6]


def test_duplicate_keys_keep_the_last(lines):
    assert parsed(lines('{"k":1,"k":2}'))[0]["k"] == 2


@pytest.mark.parametrize(
    "text, timestamp, level, message",
    [
        ('{"@timestamp":"a","timestamp":"b"}', "a", None, None),
        ('{"ts":12,"severity":3,"msg":4}', "12", "3", "4"),
        ('{"time":null,"ts":"x"}', "x", None, None),
        ('{"@timestamp":null,"timestamp":"x"}', "x", None, None),
        ('{"timestamp":"x","@timestamp":null}', None, None, None),
        ('{"Time":"t","LEVEL":"l","Message":"m"}', "t", "l", "m"),
        ('{"level":true,"lvl":"low"}', None, "low", None),
        ('{"level":true}', None, "1", None),
        ('{"message":true}', None, None, None),
        ('{"message":["q"]}', None, None, '["q"]'),
        ('{"message":null,"msg":5}', None, None, None),
        ('{"message":null,"msg":"five"}', None, None, "five"),
        ('{"message":{},"msg":"later"}', None, None, "later"),
        ('{"message":{"text":1}}', None, None, None),
        ('{"level":1.50,"ts":1e3}', "1000", "1.5", None),
    ],
)
def test_promotion(lines, text, timestamp, level, message):
    row = parsed(lines(text))[0]
    assert (row["timestamp"], row["level"], row["message"]) == (timestamp, level, message)
    # The same among records that use the aliases in every other way.
    mixed = parsed(lines(text, '{"message":[1],"level":{},"ts":true}', '{"message":5,"Level":false,"time":"t"}'))[0]
    assert (mixed["timestamp"], mixed["level"], mixed["message"]) == (timestamp, level, message)


def test_aliases_never_become_columns(lines):
    df = parse_json(lines('{"ts":1,"time":2,"timestamp":3,"lvl":4,"msg":5,"x":6}'))
    assert df.columns == ["file", "line_no", "raw", "timestamp", "level", "message", "x"]


def test_deep_nesting(lines):
    text = '{"a":' * 20 + "1" + "}" * 20
    row = parsed(lines(text, '{"b":1}'))[0]
    assert row["_".join("a" * 20)] == 1
    assert flatten_json(lines(text)).first()["key"] == "_".join("a" * 20)


def test_keys_with_quotes_and_dots(lines):
    keys = ["it's", 'say "x"', "a.b", "c[0]", "back\\slash", "both'\"", "$"]
    row = parsed(lines(json.dumps({key: n for n, key in enumerate(keys)})))[0]
    assert [row[n] for n in ["it_s", "say_x", "a_b", "c_0", "back_slash", "both", "value"]] == [0, 1, 2, 3, 4, 5, 6]


def test_flatten(lines):
    got = {(r["line_no"], r["key"], r["value"], r["kind"]) for r in flatten_json(lines('{"a":{"b":[1,2],"c":{}}}', "x", '{"d":false,"e":null}')).collect()}
    assert got == {(1, "a_b", "[1,2]", "array"), (1, "a_c", "{}", "object"), (3, "d", "0", "boolean"), (3, "e", None, "null")}


def test_too_many_columns(lines):
    """No record is lost: past the width each is kept whole, beside the promoted columns."""
    df = lines('{"a":1,"b":2,"c":3,"d":4,"Level":"x"}', '{"e":{"f":1},"msg":"m"}')
    assert len(discover_columns(df, max_columns=5).columns) == 5
    known = discover_columns(df, max_columns=4)
    assert known.wide and known.columns == []
    rows = parse_json(df, known).selectExpr("level", "message", "to_json(fields) AS kept").collect()
    assert [tuple(r) for r in rows] == [("x", None, '{"Level":"x","a":1,"b":2,"c":3,"d":4}'), (None, "m", '{"e":{"f":1},"msg":"m"}')]
    assert discover_columns(df, max_columns=1).wide


@pytest.mark.parametrize(
    "number, text",
    [(1.0, "1"), (1.5, "1.5"), (1e7, "10000000"), (1.25e10, "12500000000"), (1e20, "100000000000000000000"), (1e21, "1e+21"),
     (1.5e300, "1.5e+300"), (1e-3, "0.001"), (1.5e-5, "0.000015"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"),
     (-2.5e8, "-250000000"), (0.0, "0"), (123456789.5, "123456789.5")],
)
def test_number_text(spark, number, text):
    assert spark.createDataFrame([(number,)], "d double").select(F.expr(double_text("d"))).first()[0] == text
