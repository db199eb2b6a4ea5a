import json

import pytest
from pyspark.sql import functions as F

from vellumine.operators import captions as C
from vellumine.operators import mapping as M
from vellumine.operators import metrics as K
from vellumine.operators import sections as S
from vellumine.operators import validation as V
from vellumine.operators.documents import postprocess, postprocess_json
from vellumine.schema import DEFAULTS, METADATA


def one(spark, column):
    return spark.range(1).select(column.alias("o")).first()[0]


def secs(*pairs):
    return F.array(*[S.section(F.lit(t), F.lit(c)) for t, c in pairs]) if pairs else F.array().cast(S.SECTIONS)


def pairs(rows):
    return [(r.sectionTitle, r.sectionContent) for r in rows]


@pytest.mark.parametrize(("title", "content", "gone"), [("Methods", "Methods", True), ("x", "12%", True), ("x", "abcd", False), ("x", " ", True), ("x", "12345", False)])
def test_empty_or_self_referential(spark, title, content, gone):
    assert one(spark, S.is_empty_or_self_referential(F.lit(title), F.lit(content))) is gone


def test_demux(spark):
    given = secs(("Overview", "Figure 2. Flow"), ("figure 3", "Flow of data"), ("Table 1", "Table 1. Rows"), ("Text", "Figure of speech"))
    rest, figures, tables = S.demuxed(given)
    assert [r.captions for r in one(spark, figures)] == [["Figure 2. Flow"], ["figure 3", "Flow of data"]]
    assert [r.captions for r in one(spark, tables)] == [["Table 1. Rows"]]
    assert pairs(one(spark, rest)) == [("Text", "Figure of speech")]


def test_dedup_keeps_the_first_and_all_empty(spark):
    long = "A" * 200
    given = secs(("1", long + "x"), ("2", long.lower() + "y"), ("3", ""), ("4", ""), ("5", "b"))
    assert [t for t, _ in pairs(one(spark, S.deduplicated(given)))] == ["1", "3", "4", "5"]


def test_dedup_rows_agrees_with_arrays(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "A "), (1, 2, ""), (1, 3, ""), (2, 0, "a")], "d int, p int, c string")
    kept = S.dedup_rows(rows, "d", "p", "c").orderBy("d", "p").collect()
    assert [(r.d, r.p) for r in kept] == [(1, 0), (1, 2), (1, 3), (2, 0)]


def test_caption_removal(spark):
    f = lambda c, p: one(spark, S.without_captions(F.lit(c), F.array(*map(F.lit, p))))
    assert f("content x CAP y CAP z", ["CAP"]) == "content x  y  z"
    part = "P" * 100 + " and the rest"
    assert f("before " + "P" * 100 + " other end. After.\nLast", [part]) == "before Last"
    assert f("before " + "P" * 100 + " other\n\nLast. Line", [part]) == "before Last. Line"
    assert f("CAP\n\n\n\nx\nA B C\ny", ["CAP"]) == "x\n\ny"
    assert f("same", ["none"]) == "same"


def test_caption_shapes(spark):
    f = lambda j: [r.captions for r in one(spark, C.from_shapes(F.lit(j)))]
    assert f('{"captions":[{"captionParts":[" A ",""]},{"captionParts":[]}]}') == [["A"]]
    assert f('[{"caption1":" A ","caption2":"B"}]') == [["A", "B"]]
    assert f('[{"caption2":"2","caption10":"10","caption1":"1","x":"y"}]') == [["1", "10", "2"]]
    assert f('[{"captions":["Same","a"]},{"captions":["SAME","b"]},5]') == [["Same", "a"]]
    assert f("7") == [] and f("[]") == []
    assert f('[{"captions":["a",5,{"x":1},null,["b"]]},{"caption1":7,"caption2":"c"},{"captions":"old"}]') == [["a"], ["c"], ["old"]]


def test_postprocess_flow(spark):
    df = spark.range(1).select(
        secs(("Intro", "A long enough text with CAPTION TEXT inside."), ("Intro 2", "a long enough text with caption text inside."), ("Figure 1", "CAPTION TEXT"), ("Short", "tiny"), ("Same", "Same")).alias("sections"),
        F.array().cast(S.CAPTIONS).alias("imageCaptions"),
        F.array().cast(S.CAPTIONS).alias("tableCaptions"),
    )
    row = postprocess(df).first()
    assert pairs(row.sections) == [("Intro", "A long enough text with  inside.")]
    assert [c.captions for c in row.imageCaptions] == [["Figure 1", "CAPTION TEXT"]]


def test_postprocess_json(spark):
    docs = [
        {"posterContent": {"sections": [{"sectionTitle": "T\u200b", "sectionContent": ["part one of it", "part two"]}, "junk"]}, "imageCaption": [{"caption1": "Fig"}], "creators": [{"name": "A\u200b B"}], "domain": "d  e"},
        {"error": "No JSON found", "raw": "x"},
        {"posterContent": {"sections": "none"}, "imageCaptions": {"captions": [{"captionParts": ["x"]}]}},
    ]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, document string")
    a, b, c = (json.loads(r.document) for r in postprocess_json(rows).orderBy("i").collect())
    assert a["posterContent"]["sections"] == [{"sectionTitle": "T", "sectionContent": "part one of it part two"}]
    assert a["imageCaptions"] == [{"captions": ["Fig"]}] and "imageCaption" not in a and a["creators"][0]["name"] == "A B" and a["domain"] == "d e"
    assert b["error"] == "No JSON found" and b["imageCaptions"] == [] and "$schema" in b
    assert c["posterContent"]["sections"] == "none" and c["imageCaptions"] == [{"captions": ["x"]}]


def test_facets():
    doc = {"a": 0, "b": "x", "c": {"d": 1}}
    assert K.field_count(doc) == 3
    assert K.all_text({"a": "x", "b": [1, "y"]}) == "x  y"
    deep = {"a": 1}
    for _ in range(15):
        deep = {"a": deep}
    assert K.field_count(deep) == 11
    doc = {"posterContent": {"sections": [{"sectionContent": "s"}, {"sectionContent": ""}]}, "imageCaptions": [{"captions": ["i", ""]}], "tableCaptions": {"captions": [{"captionParts": ["t"]}]}, "imageCaption": [{"k": "old"}]}
    assert K.section_texts(doc) == ["s", "i", "t", "old"]


def test_score_and_summary(spark):
    doc = json.dumps({"posterContent": {"sections": [{"sectionTitle": "T", "sectionContent": "alpha beta gamma 42"}]}})
    other = json.dumps({"posterContent": {"sections": [{"sectionTitle": "T", "sectionContent": "delta"}]}})
    rows = spark.createDataFrame([("a", doc, doc), ("b", other, doc)], "poster_id string, generated string, reference string")
    got = {r.poster_id: r for r in K.score(rows).collect()}
    assert got["a"].passes and got["a"].rouge_l == 1.0 and got["a"].word_capture == 1.0 and got["a"].field_proportion == 1.0
    assert not got["b"].passes and got["b"].number_capture == 0.0 and got["b"].gen_sections == 1
    total = K.summary(K.score(rows).withColumn("is_error", F.lit(False))).first()
    assert (total.documents, total.passed, total.errors, total.pass_percent) == (2, 1, 0, 50.0)


def test_pass_limits_are_inclusive(spark):
    assert one(spark, K.passes(*[F.lit(x) for x in (0.75, 0.75, 0.75, 2.0)])) is True
    assert one(spark, K.passes(*[F.lit(x) for x in (0.75, 0.75, 0.75, 2.01)])) is False


def test_validation(spark):
    docs = [{"creators": [], "titles": [{"title": ""}], "publicationYear": "x", "language": None}, {"error": "e"}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, d string").select("i", V.validate("d").alias("v")).orderBy("i").collect()
    v = rows[0].v
    issues = [(w.field, w.issue) for w in v.warnings]
    assert issues[:3] == [("creators", "empty_required_array"), ("titles.0.title", "empty_string"), ("publicationYear", "wrong_type")]
    missing = [w for w in v.warnings if w.issue == "missing_required"]
    assert len(missing) == 5 and len({w.message for w in missing}) == 1 and missing[0].field == "root"
    assert v.errors_count == 8 and v.warnings_count == 8 and not v.valid
    whole = json.loads(v.document)
    assert whole["language"] is None and "language" not in v.filled_fields and list(v.filled_fields) == [k for k in DEFAULTS if k not in docs[0]]
    assert rows[1].v.warnings == [] and json.loads(rows[1].v.document) == {"error": "e"}


def test_range_violations_are_errors_without_warning():
    broken = list(V.violations({"publicationYear": 1800}, {"type": "object", "properties": {"publicationYear": {"type": "integer", "minimum": 1900}}}))
    assert len(broken) == 1 and V.warning(*broken[0]) is None
    assert not list(V.violations(2000.0, {"type": "integer"})) and list(V.violations(True, {"type": "integer"}))


def test_metadata_row(spark):
    doc = {"sizes": ["A0", "A1"], "formats": ["PDF"], "subjects": [{"subject": "s"}], "conference": {"name": "N", "conferenceName": "M"}, "_x": 1, "raw": "r", "publicationYear": 2020, "identifiers": [], "titles": [{"title": "é"}]}
    rows = spark.createDataFrame([(json.dumps(doc),), (json.dumps({"sizes": []}),)], "d string")
    a, b = (r.m for r in rows.select(M.metadata_row(F.col("d")).alias("m")).collect())
    assert (a["size"], a["format"], a["conferenceName"], a["publicationYear"], a["identifiers"]) == ('["A0", "A1"]', "PDF", "N", 2020, "[]")
    assert a["subjects"] == ['{"subject": "s"}'] and len(a) == len(METADATA) - 1
    assert b["size"] is None and b["subjects"] == []
    c = rows.select(M.metadata_row(F.col("d"), "schema").alias("m")).first().m
    assert c["conferenceName"] == "M"


def test_title_and_description(spark):
    titles = F.array(F.struct(F.lit("").alias("title")), F.struct(F.lit(" T ").alias("title")))
    d = lambda *xs: F.array(*[F.struct(F.lit(x).alias("description"), F.lit(t).alias("descriptionType")) for x, t in xs])
    assert one(spark, M.title_of(titles)) == "T"
    assert one(spark, M.description_of(d(("", "Abstract"), ("one", "Other"), ("two", " Abstract ")), secs())) == "two"
    assert one(spark, M.description_of(d(("", "Other"), ("two", "Other")), secs())) == "two"
    assert one(spark, M.description_of(d(("", "x")), secs(("An Abstract", ""), ("Abstract", "later")))) == ""


def test_halves_of_surrogate_pairs_are_no_end(spark):
    doc = '{"creators":[{"name":"\\ud83d"}],"titles":[{"title":""}],"posterContent":{"sections":[{"sectionTitle":"T","sectionContent":"long enough content \\ude00"}]},"imageCaptions":[{"captions":["fig \\ud83d"]}],"sizes":["\\ud83d"],"publicationYear":1e400,"\\ud83d":1}'
    rows = spark.createDataFrame([(doc,)], "document string")
    checked = rows.select(V.validate("document").alias("v")).first().v
    assert json.loads(checked.document)["creators"][0]["name"] == "\ud83d" and "titles.0.title" in [w.field for w in checked.warnings]
    assert rows.select(M.metadata_row(F.col("document")).alias("m")).first().m["size"] == "\ufffd"
    assert rows.select(K.facets("document").alias("f")).first().f.sections == ["long enough content \ufffd", "fig \ufffd"]
    done = json.loads(postprocess_json(rows).first().document)
    assert done["posterContent"]["sections"][0]["sectionContent"] == "long enough content \ufffd" and len(done["imageCaptions"]) == 1
