"""Whole flows: documents out of files, and a report of documents against annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import metrics, validation
from vellumine.plans.structure import structure
from vellumine.sources import files


def extract(rows: DataFrame, generator: str = "rules") -> DataFrame:
    """path, source, document, error of files (path, content). A file without text is an error row."""
    raw = files.extract(rows).withColumn("none", (F.col("text") == "") | (F.col("source") == "unknown"))
    empty = raw.filter("none").select("path", "source", F.to_json(F.struct(F.lit("No text extracted").alias("error"))).alias("document"), F.coalesce("error", F.lit("No text extracted")).alias("error"))
    full = structure(raw.filter("NOT none").select("path", "source", "text"), generator)
    return full.select("path", "source", "document", "error").unionByName(empty)


def process_file(spark: SparkSession, path: str, generator: str = "rules") -> DataFrame:
    """path, source, document, error of one file."""
    return extract(spark.read.format("binaryFile").load(path).select("path", "content"), generator)


def report(pairs: DataFrame, key: str = "poster_id") -> DataFrame:
    """key, scores, passes, is_error, error_message, source. pairs: key, generated, reference (JSON text), error, source. An error row has no scores;
    a document or a reference that is no JSON object makes one."""
    wrong = lambda c: F.concat(F.lit(f"{c}: "), metrics.facets(F.col(c))["error"])
    pairs = pairs.withColumn("error", F.coalesce("error", wrong("generated"), wrong("reference")))
    good = metrics.score(pairs.filter("error IS NULL"), key)
    info = pairs.select(key, "source", F.col("error").isNotNull().alias("is_error"), F.col("error").alias("error_message"))
    return info.join(good, key, "left").withColumn("passes", F.coalesce("passes", F.lit(False)))


def run_eval(spark: SparkSession, annotation_dir: str, output_dir: str, generator: str = "rules") -> DataFrame:
    """Extracts every annotated poster, scores it, writes raw/, extracted/ and results/; the report."""
    listed = files.list_files(spark, annotation_dir)
    pairs = files.annotation_pairs(listed.select("path"))
    found = extract(listed.join(pairs.select(F.col("poster").alias("path")), "path", "left_semi"), generator)
    found.write.mode("overwrite").parquet(f"{output_dir}/extracted")  # models run once
    done = spark.read.parquet(f"{output_dir}/extracted").withColumnRenamed("path", "poster")
    notes = listed.join(pairs.select(F.col("annotation").alias("path"), "poster_id", "poster"), "path").select("poster_id", "poster", F.decode("content", "UTF-8").alias("reference"))
    rows = report(notes.join(done, "poster").select("poster_id", F.col("document").alias("generated"), "reference", "error", "source"))
    rows.write.mode("overwrite").json(f"{output_dir}/results")
    return spark.read.schema(rows.schema).json(f"{output_dir}/results")


def checked(documents: DataFrame, column: str = "document") -> DataFrame:
    """documents with validity, counts, warnings and defaults filled in."""
    return documents.withColumn("__v", validation.validate(F.col(column))).withColumns({column: F.col("__v.document"), **{c: F.col(f"__v.{c}") for c in ("valid", "errors_count", "warnings_count", "filled_fields", "warnings")}}).drop("__v")
