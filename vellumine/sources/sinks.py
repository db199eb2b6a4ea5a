"""Writers: raw texts, extracted documents, reports; and the schema stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.operators.jobs import keyed_update, upsert
from vellumine.operators.mapping import description_of, metadata_row, title_of
from vellumine.schema import DOCUMENT, METADATA, SCHEMA_URL


def stamped(document: Column, url: str = SCHEMA_URL) -> Column:
    """A JSON object with the schema's address, if it has none."""
    has = F.array_contains(F.json_object_keys(document), "$schema")
    first = F.concat(F.lit(f'{{"$schema":"{url}"'), F.when(F.size(F.json_object_keys(document)) > 0, ",").otherwise(""), F.substr(F.ltrim(document), F.lit(2)))
    return F.when(has, document).otherwise(first)


def write_raw(texts: DataFrame, path: str, key: str = "poster_id", text: str = "text") -> None:
    """A folder for each document, with its text as it is; written again it is replaced."""
    texts.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def write_documents(documents: DataFrame, path: str, key: str = "poster_id", document: str = "document") -> None:
    """Parquet of key and JSON text: missing and null fields stay apart, nothing is escaped anew."""
    documents.select(key, document).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def saved(metadata: DataFrame, posters: DataFrame, documents: DataFrame, now: Column, conference_keys: str = "reference") -> tuple[DataFrame, DataFrame]:
    """(metadata table, poster table) after documents (posterId, document) were upserted, and titles and descriptions updated."""
    rows = documents.select("posterId", metadata_row(F.col("document"), conference_keys).alias("m")).select("posterId", *[F.col(f"m.{c}").alias(c) for c in METADATA if c != "posterId"])
    typed = documents.select("posterId", F.from_json("document", DOCUMENT).alias("d"))
    none = F.array().cast("array<struct<sectionTitle:string,sectionContent:string>>")
    told = typed.select(F.col("posterId").alias("id"), title_of(F.col("d.titles")).alias("title"), description_of(F.col("d.descriptions"), F.coalesce("d.posterContent.sections", none)).alias("description"))
    return upsert(metadata, rows, "posterId", now), keyed_update(posters, told, "id", ["title", "description"], now)
