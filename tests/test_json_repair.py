import json

import pytest
from pyspark.sql import functions as F

from vellumine.functions import json_repair as R


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('```json\n{"a":1}\n```', {"a": 1}),
        ('```\n{"a":1}\n``` more', {"a": 1}),
        ('{"a":[1,],}', {"a": [1]}),
        ('{"a":1} tail {', {"a": 1}),
        ('{"s":[{"a":"b"},', {"s": [{"a": "b"}]}),
        ('{"a":"5 pc/" wide"}', {"a": '5 pc/" wide'}),
        ('{"a":"x\ny"}', {"a": "x y"}),
        ('{"a":"\\u12"}', {"a": ""}),
        ('{"a":1,"a":2}', {"a": 2}),
        ('pre {"a":{"b":"}"}} post', {"a": {"b": "}"}}),
        ('{"a":"b', {"a": "b"}),
    ],
)
def test_parse(text, value):
    assert R.parse(text) == value


def test_errors():
    assert R.parse("hello") == {"error": "No JSON found", "raw": "hello"}
    assert R.parse('{"s":[{"a":"b')["error"] == "JSON parse failed"
    assert R.parse('{"posterContent":{"sections":[{"sectionTitle":"T","sectionContent":"cut')["error"] == "JSON parse failed"


def test_first_object_knows_strings():
    assert R.first_object('{"a":"}\\"}"} x') == '{"a":"}\\"}"}'
    assert R.first_object('{"a":1') == '{"a":1'


def test_close_cut_counts_brackets_then_braces():
    assert R.close_cut('{"s":[1,2') == '{"s":[1,2]}'
    assert R.close_cut('{"a":{"b":[{"c":"d"},') == '{"a":{"b":[{"c":"d"}]}}'


def test_parse_column_keeps_errors_as_rows(spark):
    rows = spark.createDataFrame([(0, '{"a": "é"}'), (1, "x"), (2, None)], "i int, v string").select("i", R.parse_json("v").alias("r")).orderBy("i").collect()
    assert json.loads(rows[0].r.value) == {"a": "é"} and rows[0].r.error is None
    assert rows[1].r.value is None and rows[1].r.error == "No JSON found"
    assert rows[2].r.error == "No JSON found"


def test_columns_do_what_the_parser_does(spark):
    texts = ['a 5 km/" b', '(53.1 pc/")', '{"a":[1 , ]}', "x\\u1 y\tz"]
    row = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [tuple(r) for r in row.select(R.escape_unit_quotes(F.col("v")), R.drop_trailing_commas(F.col("v")), R.drop_bad_escapes(F.col("v"))).collect()]
    assert got == [(R._quotes(t), R._commas(t), R._escapes(t)) for t in texts]


def test_trailing_commas_twice_is_once():
    s = '{"a":[1,,],}'
    assert R._commas(R._commas('{"a":[1,],}')) == R._commas('{"a":[1,],}')
    assert R._commas(s).count(",") == 1


def test_odd_answers_are_values(spark):
    answers = ['{"s":"cut \\ud83d"}', '{"error":1,"raw":2}', '{"a":' + "[" * 100_000, '{"n":' + "9" * 5000 + "}", '{"x":NaN}']
    rows = [r.r for r in spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, v string").select("i", R.parse_json("v").alias("r")).orderBy("i").collect()]
    assert rows[0].value == '{"s": "cut \\ud83d"}' and json.loads(rows[1].value) == {"error": 1, "raw": 2} and rows[1].error is None
    assert rows[2].error == "JSON parse failed" and rows[3].error == "JSON parse failed" and len(rows[2].raw) == R.RAW
    assert rows[4].value == '{"x": NaN}'
