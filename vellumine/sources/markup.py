"""Layout markup (ALTO XML) and simple HTML to lines of text."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.udf import arrow


def _elements(node: ElementTree.Element, tags: list[str]) -> Iterator[ElementTree.Element]:
    """Those of the tags, in document order; a single tag (the rule) is looked for by the tree itself."""
    return node.iter(tags[0]) if len(tags) == 1 else (e for e in node.iter() if e.tag in tags)


def _alto(document: str | None) -> str | None:
    try:
        root = ElementTree.fromstring((document or "").strip())
    except ElementTree.ParseError:
        return None
    tags = {e.tag for e in root.iter()}
    named = lambda kind: [t for t in tags if isinstance(t, str) and t.rpartition("}")[2].rpartition(":")[2] == kind]
    block_tags, string_tags = named("TextBlock"), named("String")
    blocks = ([c for s in _elements(block, string_tags) if (c := s.get("CONTENT"))] for block in _elements(root, block_tags))
    return "\n".join(" ".join(words) for words in blocks if words)


@arrow("string")
def alto_text(xml: list[str | None]) -> list[str | None]:
    """A line for each TextBlock: the CONTENT of its strings, empty ones left out. Name spaces don't matter; null for what is no XML."""
    return [_alto(x) for x in xml]


def html_lines(html: Column, tags: tuple[str, ...] = ("h1", "p", "li")) -> Column:
    """Texts of the elements, in page order, without markup inside them; empty ones left out."""
    found = F.regexp_extract_all(html, F.lit(rf"(?s)<({'|'.join(tags)})\b[^>]*>(.*?)(?=</?(?:{'|'.join(tags)})\b|</)"), F.lit(2))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")


def read_alto(spark, path: str) -> DataFrame:
    """path, text of ALTO files."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), alto_text(F.col("value")).alias("text"))
