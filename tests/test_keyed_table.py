"""Changes to a table in buckets against the plain transforms, and what they leave alone."""

import os

from pyspark.sql import functions as F

from vellumine.operators import jobs
from vellumine.operators.keyed_table import KeyedTable

SCHEMA = "id bigint, title string, n bigint, created timestamp, updated timestamp"


def at(text):
    return F.lit(text).cast("timestamp")


def files(folder):
    return {b: sorted((f, os.stat(folder / b / f).st_mtime_ns) for f in os.listdir(folder / b)) for b in os.listdir(folder) if b.startswith("bucket=")}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def table(spark, folder, n=200, buckets=16):
    rows = spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("title"), (F.col("id") * 2).alias("n"), at("2020-01-01").alias("created"), at("2020-01-01").alias("updated"))
    return rows, KeyedTable(spark, f"file://{folder}", rows.schema, "id", buckets).create(rows)


def test_upsert_equals_the_plain_one_and_leaves_other_buckets(spark, tmp_path):
    folder = tmp_path / "t"
    rows, kept = table(spark, folder)
    change = spark.createDataFrame([(3, "new"), (500, "more"), (None, "none")], "id bigint, title string")
    before, now = files(folder), at("2021-01-01")
    written = kept.upsert(change, now)
    after = files(folder)
    assert 1 <= len(written) <= 2
    assert {b for b in after if after[b] != before.get(b)} == {f"bucket={b}" for b in written}
    want = rows_of(jobs.upsert(rows, change.filter("id IS NOT NULL"), "id", now))
    assert rows_of(kept.rows()) == want
    kept.upsert(change, now)
    assert rows_of(kept.rows()) == want


def test_only_touched_buckets_are_read(spark, tmp_path):
    _, kept = table(spark, tmp_path / "t")
    buckets = kept.touched(spark.createDataFrame([(3,)], "id bigint"))
    read = kept.rows(buckets).inputFiles()
    assert len(kept.rows().inputFiles()) == 16 and len(buckets) == 1
    plan = kept.rows(buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert len(read) >= 1 and kept.rows(buckets).select(F.input_file_name()).distinct().count() == 1


def test_update_inserts_nothing_and_no_rows_touch_nothing(spark, tmp_path):
    folder = tmp_path / "t"
    rows, kept = table(spark, folder)
    before, now = files(folder), at("2022-01-01")
    none = spark.createDataFrame([], "id bigint, title string")
    assert kept.upsert(none, now) == [] and kept.update(none, ["title"], now) == [] and files(folder) == before
    change = spark.createDataFrame([(7, "seven"), (900, "not there")], "id bigint, title string")
    kept.update(change, ["title"], now)
    assert rows_of(kept.rows()) == rows_of(jobs.keyed_update(rows, change, "id", ["title"], now))
    assert kept.rows().count() == 200


def test_buckets_that_were_empty_and_other_types_of_key(spark, tmp_path):
    rows, kept = table(spark, tmp_path / "t", n=1)
    change = spark.createDataFrame([(i, f"x{i}") for i in range(40)], "id int, title string")  # the table's key is a bigint
    kept.upsert(change, at("2021-01-01"))
    got = {r.id: (r.title, r.n) for r in kept.rows().collect()}
    assert got == {i: (f"x{i}", None) for i in range(40)}


def test_a_table_without_rows(spark, tmp_path):
    rows, _ = table(spark, tmp_path / "t", n=1)
    kept = KeyedTable(spark, f"file://{tmp_path}/e", rows.schema, "id", 4).create(rows.limit(0))
    assert kept.rows().count() == 0
    kept.upsert(spark.createDataFrame([(1, "a")], "id bigint, title string"), at("2021-01-01"))
    assert [r.title for r in kept.rows().collect()] == ["a"]
