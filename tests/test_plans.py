import json

from pyspark.sql import functions as F

from vellumine.plans import evaluate, structure
from vellumine.sources import files


def test_rules_structure(spark):
    text = "A title\nMethods:\nWe did it.\nFigure 1. Flow\nResults\nIt worked well enough."
    doc = structure.structured(text)
    assert doc["titles"] == [{"title": "A title"}] and [s["sectionTitle"] for s in doc["posterContent"]["sections"]] == ["Methods", "Results"]
    rows = structure.structure(spark.createDataFrame([(1, text)], "i int, text string"))
    got = json.loads(rows.first().document)
    assert got["imageCaptions"] == [{"captions": ["Figure 1. Flow"]}] and got["posterContent"]["sections"][-1]["sectionContent"] == "It worked well enough."


def test_retries_reach_only_failures(spark):
    def generate(prompt, tokens):
        return F.when(prompt.contains("never"), "no object").when(F.lit(tokens < structure.RETRY_TOKENS) & prompt.contains("later"), '{"a": [{"b": "c').otherwise('{"a": 1}')

    structure.GENERATORS["test"] = generate
    try:
        rows = spark.createDataFrame([(0, "now"), (1, "later"), (2, "never")], "i int, text string")
        got = {r.i: json.loads(r.document) for r in structure.structure(rows, "test", finish=False).collect()}
    finally:
        del structure.GENERATORS["test"]
    assert got[0] == {"a": 1} and got[1] == {"a": 1} and got[2]["error"] == "No JSON found" and len(got) == 3


def test_answers_that_say_error_are_asked_again(spark):
    def generate(prompt, tokens):
        return F.when(F.lit(tokens < structure.RETRY_TOKENS), '{"error": "busy"}').when(prompt.contains("always"), '{"error": "busy", "raw": "{"}').otherwise('{"a": 1}')

    structure.GENERATORS["test"] = generate
    try:
        rows = spark.createDataFrame([(0, "now"), (1, "always")], "i int, text string")
        got = {r.i: (json.loads(r.document), r.error) for r in structure.structure(rows, "test", finish=False).collect()}
    finally:
        del structure.GENERATORS["test"]
    assert got == {0: ({"a": 1}, None), 1: ({"error": "busy", "raw": "{"}, "busy")}


def test_a_model_answers_in_batches(spark):
    structure.GENERATORS["test"] = structure.batch_generator(lambda: lambda prompts, most: [json.dumps({"n": len(p), "most": most}) for p in prompts])
    try:
        got = json.loads(structure.structure(spark.createDataFrame([("x",)], "text string"), "test", finish=False).first().document)
    finally:
        del structure.GENERATORS["test"]
    assert got == {"n": len(structure.PROMPT) + 1, "most": structure.FIRST_TOKENS}


def test_run_eval(spark, tmp_path):
    folder = tmp_path / "in" / "7"
    folder.mkdir(parents=True)
    text = "Title\nResults\n" + "Numbers like 42 and many other words came out of it. " * 15
    (folder / "p.pdf").write_text(text)
    (folder / "7_sub-json.json").write_text(json.dumps(structure.structured(text)))
    files.register("layout", lambda path, content: content.decode())
    try:
        row = evaluate.run_eval(spark, str(tmp_path / "in"), str(tmp_path / "out")).first()
    finally:
        files.EXTRACTORS.clear()
    files.register("layout", lambda path, content: content.decode())
    try:
        one = evaluate.process_file(spark, str(folder / "p.pdf")).first()
    finally:
        files.EXTRACTORS.clear()
    assert one.source == "layout" and json.loads(one.document)["titles"] == [{"title": "Title"}]
    assert row.poster_id == "7" and row.passes and row.word_capture >= 0.75 and row.source == "layout" and not row.is_error


def test_checked(spark):
    row = evaluate.checked(spark.createDataFrame([(json.dumps({"titles": []}),)], "document string")).first()
    assert not row.valid and "doi" in row.filled_fields


def test_command_line(spark, tmp_path, capsys):
    from vellumine.__main__ import main

    folder = tmp_path / "in" / "9"
    folder.mkdir(parents=True)
    (folder / "p.pdf").write_text("x")
    (folder / "9_sub-json.json").write_text('{"titles": []}')
    main(["--annotation-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out")])
    assert "No text extracted" in capsys.readouterr().out


def test_a_model_is_asked_once_for_a_row_and_a_rung(spark, tmp_path):
    """Whatever is made of the answers, and also if they differ from call to call."""
    from pyspark.sql import functions as F

    asked = tmp_path / "asked"
    asked.mkdir()

    def load():
        def model(prompts, most_tokens):
            import uuid

            for p in prompts:
                (asked / f"{uuid.uuid4().hex}").write_text(p[-1] + str(most_tokens) + p[:5])
            return ["no json" if "row 1" in p or "row 2" in p else '{"k": 1}' for p in prompts]

        return model

    structure.GENERATORS["counting"] = structure.batch_generator(load)
    rows = spark.createDataFrame([(i, f"row {i}") for i in range(5)], "i int, text string")
    try:
        done = structure.structure(rows, "counting", finish=False)
        assert done.count() == 5 and len(done.collect()) == 5 and done.filter(F.col("document").contains('k')).count() == 3
    finally:
        del structure.GENERATORS["counting"]
    assert len(list(asked.iterdir())) == 5 + 2 + 2  # all rows, then twice those that failed


BROKEN = ['{"a":', "[1]", "7", '"x"', "null", "[" * 1500 + "]" * 1500, '{"a":' * 1500 + "1" + "}" * 1500, "", None]


def test_no_document_kills_a_job(spark):
    from pyspark.sql import functions as F

    from vellumine.operators import mapping, metrics, validation
    from vellumine.plans import evaluate

    good = '{"titles": [{"title": "T"}], "content": {"sections": []}}'
    rows = spark.createDataFrame([(i, d) for i, d in enumerate([*BROKEN, good])], "i int, d string")
    n = len(BROKEN)
    facets = {r.i: r.f for r in rows.select("i", metrics.facets(F.col("d")).alias("f")).collect()}
    assert all(facets[i].error and facets[i].fields == 0 for i in range(5)) and facets[n].error is None and facets[n].all_text.strip() == "T"
    checks = {r.i: r.v for r in rows.select("i", validation.validate(F.col("d")).alias("v")).collect()}
    assert all(checks[i].valid is None and json.loads(checks[i].document)["error"] and json.loads(checks[i].document)["raw"] == BROKEN[i] for i in range(5))
    mapped = {r.i: r.m for r in rows.select("i", mapping.metadata_row(F.col("d")).alias("m")).collect()}
    assert len(mapped) == n + 1 and mapped[1] == mapped[8]
    pairs = [(str(i), d, good, None, "s") for i, d in enumerate(BROKEN)] + [("r", good, "[1]", None, "s"), ("e", good, good, "said so", "s"), ("ok", good, good, None, "s")]
    got = {r.poster_id: r for r in evaluate.report(spark.createDataFrame(pairs, "poster_id string, generated string, reference string, error string, source string")).collect()}
    assert len(got) == len(pairs) and got["ok"].is_error is False and got["ok"].word_capture is not None
    assert all(got[str(i)].is_error and got[str(i)].error_message.startswith("generated: ") and got[str(i)].word_capture is None and not got[str(i)].passes for i in range(5))
    assert got["r"].error_message.startswith("reference: ") and got["e"].error_message == "said so"
