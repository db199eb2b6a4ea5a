import datetime as dt
import json

from pyspark.sql import functions as F

from vellumine.schema import METADATA, SCHEMA_URL
from vellumine.sources import files, sinks

NOW = dt.datetime(2024, 1, 1)


def test_stamp(spark):
    rows = spark.createDataFrame([(0, '{"a":1}'), (1, ' {}'), (2, '{"$schema":"x"}')], "i int, d string")
    got = [json.loads(r.s) for r in rows.select("i", sinks.stamped(F.col("d")).alias("s")).orderBy("i").collect()]
    assert got == [{"$schema": SCHEMA_URL, "a": 1}, {"$schema": SCHEMA_URL}, {"$schema": "x"}]


def test_raw_texts_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ny"), ("b", "é")], "poster_id string, text string")
    sinks.write_raw(rows, f"{tmp_path}/raw")
    back = {r.poster_id: r.value for r in spark.read.text(f"{tmp_path}/raw", wholetext=True).collect()}
    assert {k: v.rstrip("\n") for k, v in back.items()} == {"a": "x\ny", "b": "é"}
    sinks.write_documents(rows.withColumnRenamed("text", "document"), f"{tmp_path}/docs")
    assert spark.read.parquet(f"{tmp_path}/docs").count() == 2


def test_saved_upserts_and_updates(spark):
    kinds = {"subjects": "array<string>", "publicationYear": "bigint", "conferenceYear": "bigint", "posterId": "bigint"}
    table = spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in METADATA) + ", created timestamp, updated timestamp")
    posters = spark.createDataFrame([(1, "old", "old", NOW), (2, "old", "old", NOW)], "id bigint, title string, description string, updated timestamp")
    doc = {"titles": [{"title": "T"}], "posterContent": {"sections": [{"sectionTitle": "Abstract", "sectionContent": "D"}]}, "language": "en", "sizes": ["A0"]}
    meta, after = sinks.saved(table, posters, spark.createDataFrame([(1, json.dumps(doc))], "posterId bigint, document string"), F.lit(NOW))
    row = meta.first()
    assert (row.posterId, row.language, row["size"], row.doi, row.created) == (1, "en", "A0", None, NOW)
    assert {r.id: (r.title, r.description) for r in after.collect()} == {1: ("T", "D"), 2: ("old", "old")}


def test_objects(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    assert files.read_objects(spark, f"{tmp_path}/", ["/a.pdf"]).first().content == b"x"
    assert spark.range(1).select(files.object_path("s3a://b/", F.lit("//k/f"))).first()[0] == "s3a://b/k/f"
