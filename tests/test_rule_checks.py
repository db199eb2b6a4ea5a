import json
import random

import pytest
from pyspark.sql import functions as F

from vellumine.operators import rule_checks as R
from vellumine.operators.validation import validate, violations, warning
from vellumine.schema import RULES

ODD = [None, True, False, 0, 1, -3, 1899, 1900, 2100, 2101, 2000.0, 2000.5, 1e300, 10**40, "", "x", "é😀", "Personal", "Abstract", [], [None], [""], [{}], {}, {"name": ""}, {"sections": [{}, 7]}, [[1]], [1.0]]


def document(rule, rng, depth=0):
    if rng.random() < 0.12:
        return rng.choice(ODD)
    kind = rule.get("type")
    if kind == "object":
        made = {k: document(r, rng, depth + 1) for k, r in rule["properties"].items() if rng.random() < (0.9 if depth == 0 else 0.75)}
        return {**made, "other key": 1} if rng.random() < 0.2 else made
    if kind == "array":
        return [document(rule["items"], rng, depth + 1) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
    if kind == "integer":
        return rng.choice([1899, 1900, 2024, 2024.0, 2024.5, "2024", 2101])
    return rng.choice([*rule.get("enum", []), "", "some text", " "])


def plain(text):
    doc = json.loads(text)
    if not isinstance(doc, dict) or "error" in doc:
        return None, None, None, []
    broken = list(violations(doc, RULES))
    told = [w for b in broken if (w := warning(*b))]
    return not broken, len(broken), len(told), told


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [json.dumps(document(RULES, rng), ensure_ascii=rng.random() < 0.5) for _ in range(1500)]
    return [*made, *[json.dumps({k: x}) for k in RULES["properties"] for x in ODD], '{"error": null}', '{"error": "e", "titles": []}', ' {"titles" : [ ] }\n', "[1]", "7", '"x"', "null", "{}"]


def shown(c):
    return c.valid, c.errors_count, c.warnings_count, [(w.field, w.issue, w.message) for w in c.warnings]


def test_equals_the_plain_rules_on_random_documents_without_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, document string").select("i", R.checks(F.col("document")).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and "InPandas" not in plan
    got = {r.i: r.c for r in df.collect()}
    assert all(got[i].parsed for i in range(len(texts)))
    assert sum(len(c.warnings) for c in got.values()) > 3000
    for i, t in enumerate(texts):
        assert shown(got[i]) == plain(t), t


BROKEN = ['{"a":', "", " ", "{} x", '{"titles": []}] x', '{"a": 1}, {"b": 2}', "{'a': 1}", '{"a": NaN}', '{"titles": [], "titles": [{"title": ""}]}', "[" * 1500 + "]" * 1500, '{"a":' * 1500 + "1" + "}" * 1500, "nul", None, '{"titles": [{"title": ""}], "x": Infinity}']


def test_what_is_no_whole_json_is_not_parsed_and_goes_to_python(spark):
    df = spark.createDataFrame(list(enumerate(BROKEN)), "i int, document string")
    raw = [r.c for r in df.select("i", R.checks(F.col("document")).alias("c")).orderBy("i").collect()]
    assert not any(c.parsed for c in raw) and all(shown(c) == (None, None, None, []) for c in raw)
    both = R.checked(df).withColumn("v", validate(F.col("document"))).orderBy("i").collect()
    assert [shown(r.checks) for r in both] == [shown(r.v) for r in both]
    assert both[8].checks.errors_count > 0 and both[0].checks.valid is None


def test_checked_equals_validate(spark, texts):
    df = R.checked(spark.createDataFrame([(t,) for t in [*texts[:300], *BROKEN]], "document string").withColumn("v", validate(F.col("document"))))
    assert all(shown(r.checks) == shown(r.v) for r in df.collect())
