"""Scores of a generated document against its reference, and the report over many."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.functions.json_repair import read_object, storable
from vellumine.functions.rouge import rouge_l
from vellumine.functions.udf import arrow

DEEPEST = 10


def all_text(node: object) -> str:
    """All strings, depth first, with spaces between; numbers and the like leave only their space."""
    if isinstance(node, (dict, list)):
        return " ".join(map(all_text, node.values() if isinstance(node, dict) else node))
    return node if isinstance(node, str) else ""


def field_count(node: object, depth: int = 0) -> int:
    """Values of objects that aren't empty or false, at any depth down to DEEPEST."""
    if depth > DEEPEST:
        return 0
    if isinstance(node, dict):
        return sum(1 + field_count(v, depth + 1) for v in node.values() if v)
    return sum(field_count(v, depth + 1) for v in node) if isinstance(node, list) else 0


def section_texts(doc: object) -> list[str]:
    """Contents of sections, then parts of captions (images, tables), then captions of the oldest shape."""
    if not isinstance(doc, dict):
        return []
    found: list[object] = []
    if isinstance(content := doc.get("posterContent"), dict):
        found += [s.get("sectionContent") for s in content.get("sections", []) if isinstance(s, dict)]
    for key in ("imageCaptions", "tableCaptions"):
        held, names = doc.get(key), ("captions", "captionParts")
        if isinstance(held, dict):
            held, names = held.get("captions", []), names[::-1]
        for caption in held if isinstance(held, list) else ():
            if isinstance(caption, dict):
                found += caption.get(names[0], caption.get(names[1], []))
    for key in ("imageCaption", "tableCaption"):
        for caption in doc[key] if isinstance(doc.get(key), list) else ():
            if isinstance(caption, dict):
                found += caption.values()
    return [" ".join(map(str, x)) if isinstance(x, list) else str(x) for x in found if x]


def _facets(text: str | None) -> tuple[str, list[str], int, str | None]:
    doc, wrong = read_object(text)
    try:
        return storable(all_text(doc)), [storable(x) for x in section_texts(doc)], field_count(doc), wrong
    except RecursionError:
        return "", [], 0, "nested too deeply"


@arrow("struct<all_text:string,sections:array<string>,fields:long,error:string>")
def facets(documents: list[str | None]) -> list[tuple]:
    """What the scores need of a JSON document, in one pass. error: why a text has none of it."""
    return [_facets(d) for d in documents]


def word_capture(generated: Column, reference: Column) -> Column:
    """Share of the reference's distinct words that were generated. Both as sets (text.word_set)."""
    return F.size(F.array_intersect(generated, reference)) / F.greatest(F.size(reference), F.lit(1))


def number_capture(generated: Column, reference: Column) -> Column:
    """The same for numbers (text.number_set); 1 where the reference has none."""
    return F.when(F.size(reference) == 0, 1.0).otherwise(F.size(F.array_intersect(generated, reference)) / F.greatest(F.size(reference), F.lit(1)))


def field_proportion(generated: Column, reference: Column) -> Column:
    return generated / F.greatest(reference, F.lit(1))


def passes(word: Column, rouge: Column, number: Column, field: Column) -> Column:
    return (word >= 0.75) & (rouge >= 0.75) & (number >= 0.75) & field.between(0.5, 2.0)


def section_rouge(pairs: DataFrame, key: str, generated: str, reference: str) -> DataFrame:
    """key, section_rouge: the mean over reference sections of the best score of a generated one; 0 without sections on a side.

    Sections are compared within their document only; a pair is a row, so that long documents spread over tasks."""
    refs = pairs.select(key, F.posexplode(reference).alias("at", "r")).withColumn("r", X.normalize(F.col("r")))
    gens = pairs.select(key, F.explode(generated).alias("g")).withColumn("g", X.normalize(F.col("g")))
    scored = refs.join(gens, key).select(key, "at", rouge_l("r", "g").alias("f"))
    best = scored.groupBy(key, "at").agg(F.max("f").alias("f"))
    return best.groupBy(key).agg(F.avg("f").alias("section_rouge"))


def score(pairs: DataFrame, key: str = "poster_id", generated: str = "generated", reference: str = "reference") -> DataFrame:
    """key, the four scores, numbers of sections, passes. generated, reference: JSON text. Pairs of which one is no JSON object have no row."""
    f = pairs.select(key, facets(F.col(generated)).alias("g"), facets(F.col(reference)).alias("r")).filter("g.error IS NULL AND r.error IS NULL")
    t = f.select(key, X.normalize(F.col("g.all_text")).alias("gt"), X.normalize(F.col("r.all_text")).alias("rt"), F.col("g.sections").alias("gs"), F.col("r.sections").alias("rs"), F.col("g.fields").alias("gf"), F.col("r.fields").alias("rf"))
    by_section = section_rouge(t.select(key, "gs", "rs"), key, "gs", "rs")
    joined = t.withColumn("whole_rouge", rouge_l("rt", "gt")).join(by_section, key, "left")
    out = joined.select(
        key,
        word_capture(X.word_set(F.col("gt")), X.word_set(F.col("rt"))).alias("word_capture"),
        F.greatest("whole_rouge", F.coalesce("section_rouge", F.lit(0.0))).alias("rouge_l"),
        number_capture(X.number_set(F.col("gt")), X.number_set(F.col("rt"))).alias("number_capture"),
        field_proportion(F.col("gf"), F.col("rf")).alias("field_proportion"),
        F.size("gs").alias("gen_sections"),
        F.size("rs").alias("ref_sections"),
    )
    return out.withColumn("passes", passes(*[F.col(c) for c in ("word_capture", "rouge_l", "number_capture", "field_proportion")]))


def summary(report: DataFrame) -> DataFrame:
    """One row: rows with scores and their means, passes, errors, share of passes."""
    scored = F.col("word_capture").isNotNull()
    return report.agg(
        F.count("*").alias("documents"),
        F.count_if(scored).alias("scored"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("word_capture", "rouge_l", "number_capture", "field_proportion")],
        F.count_if("passes").alias("passed"),
        F.count_if("is_error").alias("errors"),
        (100.0 * F.count_if("passes") / F.greatest(F.count("*"), F.lit(1))).alias("pass_percent"),
    )


def preferred(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")
