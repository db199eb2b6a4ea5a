import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumine.functions import text as X


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_clean_unicode_drops_marks_and_keeps_lines(spark):
    assert apply(spark, X.clean_unicode, "a\u200bb  c ", "a\n  b", "", None) == ["ab c", "a\n b", "", None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \n\t\u200b \u00adab.é", max_size=12), min_size=1, max_size=20))
def test_clean_unicode_twice_is_once(spark, texts):
    once = apply(spark, X.clean_unicode, *texts)
    assert apply(spark, X.clean_unicode, *once) == once


def test_strip_is_pythons(spark):
    texts = ["  a \n", "\x1c a\x85", " ", "a b", "\t x\u3000", "é  "]
    assert apply(spark, X.strip, *texts) == [t.strip() for t in texts]


@pytest.mark.parametrize(("text", "chart"), [("1 2 3 4 5", True), ("1 2 3 4", False), ("a Relative thing", True), ("x vs expression Relative", True), ("plain words", False)])
def test_chart_predicate(spark, text, chart):
    assert apply(spark, X.has_chart_data, text) == [chart]


def test_chart_cleaning(spark):
    kept = "This sentence has many more letters than digits, 7."
    assert apply(spark, X.clean_chart_data, f"1 2 3 4 5 6\n{kept}\n9 9") == [kept]
    assert apply(spark, X.clean_chart_data, "1 2 3 4 5 6") == ["1 2 3 4 5 6"]


def test_table_cleaning(spark):
    content = "The first sentence is the summary. Row 1 has 5. Row 2 has 6."
    f = lambda title: lambda c: X.clean_table_data(c, F.lit(title))
    assert apply(spark, f("Results"), content) == ["The first sentence is the summary."]
    assert apply(spark, f("Methods"), content) == [content]
    assert apply(spark, f("results"), content) == [content]


def test_long_text_without_punctuation(spark):
    long = "word " * 30_000
    assert apply(spark, X.has_table_data, long) == [False]
    assert apply(spark, X.clean_chart_data, "7 " * 20_000) == ["7 " * 20_000]


def test_normalize_glues_words_at_commas(spark):
    f = lambda c: X.alphanumeric(X.normalize(c))
    assert apply(spark, f, "alpha, beta", "alpha,\nbeta", "Müller", "10²", "x – y") == ["alphabeta", "alpha beta", "muller", "102", "x y"]
    g = lambda c: X.alphanumeric(X.normalize(c, legacy_comma_quirk=False))
    assert apply(spark, g, "alpha, beta") == ["alpha beta"]


def test_nfkd(spark):
    assert apply(spark, X.nfkd, "ﬁé", None) == [unicodedata.normalize("NFKD", "ﬁé"), None]


def test_number_set(spark):
    rows = apply(spark, X.number_set, "2015 2005 2015. 123456 0.5 2005 x9", "none")
    assert sorted(rows[0]) == sorted({"2005", "2015.", "0.5", "9"})
    assert rows[1] == []


@pytest.mark.parametrize(("text", "cut"), [('{"a":"}"', True), ('{"a":1}', False), ("[1,", True), ('{"a":1} ,', True), ("x", False)])
def test_truncated(spark, text, cut):
    assert apply(spark, X.is_truncated, text) == [cut]


def test_first_sentence(spark):
    assert apply(spark, X.first_sentence, "One two. Three!  Four") == ["One two."]
    assert re.split(r"(?<=[.!?])\s+", "One two. Three!  Four")[0] == "One two."
