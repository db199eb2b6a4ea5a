"""Files of posters: listing, routing to an extractor, pairing with annotations, downloads, settings."""

from __future__ import annotations

import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators.metrics import preferred

IMAGES, PDF = ["jpg", "jpeg", "png"], "pdf"
#: An extractor's text counts only beyond so many characters.
ENOUGH = 500
#: Poster files next to an annotation, the best first.
PREFERENCE = {"pdf": 0, "jpg": 1, "png": 2}

#: (path, content) to a text or None. None of the tools is at hand here: register one to use it.
Extractor = Callable[[str, bytes], str | None]
EXTRACTORS: dict[str, Extractor] = {}


def register(name: str, extractor: Extractor) -> None:
    """name: layout (PDF with reading order), plain (PDF), ocr (images)."""
    EXTRACTORS[name] = extractor


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of all files below a folder; content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, document: whole files as text, so that missing and null stay apart."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def route(path: Column, layout: Column, plain: Column, ocr: Column, cached: Column) -> tuple[Column, Column]:
    """(text, source) by the file's suffix, from what each extractor gave; cached is an earlier OCR text."""
    kind = suffix(path)
    image = kind.isin(IMAGES)
    enough = lambda c: F.coalesce(F.length(c) > ENOUGH, F.lit(False))
    text = F.when(image & enough(cached), cached).when(image, ocr).when((kind == PDF) & enough(layout), layout).when(kind == PDF, plain).otherwise("")
    source = F.when(image & enough(cached), "ocr_cached").when(image, "ocr").when((kind == PDF) & enough(layout), "layout").when(kind == PDF, "plain").otherwise("unknown")
    return text, source


def extract(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """path, text, source, error for files (path, content). Slow tools run only on what the cache (path, text) and the suffix leave over."""
    known = files if cache is None else files.join(cache.select("path", F.col("text").alias("cached")), "path", "left")
    known = known if cache is not None else known.withColumn("cached", F.lit(None).cast("string"))
    tools = dict(EXTRACTORS)
    schema = "path string, cached string, layout string, plain string, ocr string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, cached in zip(batch["path"], batch["content"], batch["cached"], strict=True):
                got: dict[str, str | None] = dict.fromkeys(("layout", "plain", "ocr"))
                error = None
                kind = path.rpartition(".")[2].lower()
                wanted = ["ocr"] if kind in IMAGES and len(cached or "") <= ENOUGH else ["layout", "plain"] if kind == PDF else []
                for name in wanted:
                    if name == "plain" and len(got["layout"] or "") > ENOUGH or name not in tools:
                        continue
                    try:
                        got[name] = tools[name](path, bytes(content))
                    except Exception as e:  # a file that breaks a tool is a row with an error
                        error = f"{name}: {e}"
                rows.append((path, cached, got["layout"], got["plain"], got["ocr"], error))
            yield pd.DataFrame(rows, columns=["path", "cached", "layout", "plain", "ocr", "error"])

    got = known.select("path", "content", "cached").mapInPandas(run, schema)
    text, source = route(F.col("path"), *[F.col(c) for c in ("layout", "plain", "ocr", "cached")])
    return got.select("path", F.coalesce(text, F.lit("")).alias("text"), source.alias("source"), "error")


def after_last(c: Column, word: str = "assistant") -> Column:
    """What a chat model says after the last mention of its role."""
    from vellumine.functions.text import strip

    return F.when(c.contains(word), strip(F.substring_index(c, word, -1))).otherwise(c)


def annotation_pairs(files: DataFrame) -> DataFrame:
    """poster_id, poster, annotation: folders that hold a poster and a *_sub-json.json. Of several the preferred poster, then the least name."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("poster_id"), suffix(F.col("path")).alias("kind"))
    rank = F.create_map(*[F.lit(x) for kv in PREFERENCE.items() for x in kv])
    posters = preferred(named.filter(F.col("kind").isin(list(PREFERENCE))), "poster_id", rank[F.col("kind")], F.col("path"))
    notes = preferred(named.filter(F.col("path").endswith("_sub-json.json")), "poster_id", F.col("path"))
    return posters.select("poster_id", F.col("path").alias("poster")).join(notes.select("poster_id", F.col("path").alias("annotation")), "poster_id").orderBy("poster_id")


def setting(name: str, default: str | None = None, env_file: str = ".env") -> str | None:
    """From the environment, else the .env file, else the default; an empty value counts as none. Values are never printed."""
    if os.environ.get(name):
        return os.environ[name]
    if os.path.exists(env_file):
        with open(env_file) as f:
            found = dict(line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
        if found.get(name):
            return found[name].strip("\"'")
    return default


def read_jobs(spark: SparkSession, url: str, dbtable: str = '"ExtractionJob"', **options: str) -> DataFrame:
    """The job table over JDBC; filters, columns and limits are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()


def object_path(base: str, path: Column) -> Column:
    """Where a stored file is: base and path with one slash between."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""))


def download(rows: DataFrame, base: str, key: str | None = None, header: str = "AccessKey", timeout: float = 120.0) -> DataFrame:
    """path, content, error of stored files over HTTP, for rows of any number (path): tasks fetch them one after another. What can't be had is a row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for path in batch["path"]:
                asked = urllib.request.Request(f"{base.rstrip('/')}/{urllib.parse.quote((path or '').lstrip('/'))}", headers={header: key} if key else {})
                try:
                    with urllib.request.urlopen(asked, timeout=timeout) as answer:
                        got.append((path, answer.read(), None))
                except OSError as e:  # also what HTTP says by its status
                    got.append((path, None, str(e)))
            yield pd.DataFrame(got, columns=["path", "content", "error"])

    return rows.select("path").mapInPandas(run, "path string, content binary, error string")


def read_objects(spark: SparkSession, base: str, wanted: list[str]) -> DataFrame:
    """path, content of some objects, through Spark's file systems (s3a, abfss, hdfs, file); credentials come from the session's settings."""
    return spark.read.format("binaryFile").load([f"{base.rstrip('/')}/{p.lstrip('/')}" for p in wanted]).select("path", "content")
