"""Sections of a document: array<struct<sectionTitle, sectionContent>>, cleaned, routed and deduplicated in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.functions.bind import let

SECTIONS = "array<struct<sectionTitle:string,sectionContent:string>>"
CAPTIONS = "array<struct<captions:array<string>>>"
KEY, CAPTION_KEY = 200, 100


def is_empty_or_self_referential(title: Column, content: Column) -> Column:
    c = X.strip(F.coalesce(content, F.lit("")))
    return (c == "") | (c == X.strip(F.coalesce(title, F.lit("")))) | ((F.length(c) < 5) & ~c.rlike(r"\p{L}"))


def is_captioned(title: Column, content: Column, word: str) -> Column:
    """A caption that stands as a section: word is Figure or Table."""
    begins = rf"(?iU)\A[\s\x1C-\x1F]*+{word}\s+\d+"
    return title.rlike(begins) | content.rlike(begins + r"\.")


def as_caption(title: Column, content: Column, word: str) -> Column:
    return F.when(content.startswith(word), F.array(content)).otherwise(F.array(title, content))


def section(title: Column, content: Column) -> Column:
    return F.struct(title.alias("sectionTitle"), content.alias("sectionContent"))


def cleaned(sections: Column) -> Column:
    """Titles and contents without invisible marks; empty and self-referential sections left out."""
    plain = F.transform(F.coalesce(sections, F.array().cast(SECTIONS)), lambda s: section(X.clean_unicode(X.strip(F.coalesce(s["sectionTitle"], F.lit("")))), X.clean_unicode(X.strip(F.coalesce(s["sectionContent"], F.lit(""))))))
    return F.filter(plain, lambda s: ~is_empty_or_self_referential(s["sectionTitle"], s["sectionContent"]))


def demuxed(sections: Column) -> tuple[Column, Column, Column]:
    """(sections that stay, figure captions, table captions). What is a figure isn't looked at as a table."""
    figure = lambda s: is_captioned(s["sectionTitle"], s["sectionContent"], "Figure")
    table = lambda s: ~figure(s) & is_captioned(s["sectionTitle"], s["sectionContent"], "Table")
    caption = lambda word: lambda s: F.struct(as_caption(s["sectionTitle"], s["sectionContent"], word).alias("captions"))
    rest = F.filter(sections, lambda s: ~figure(s) & ~table(s))
    return rest, F.transform(F.filter(sections, figure), caption("Figure")), F.transform(F.filter(sections, table), caption("Table"))


def tidied(sections: Column, least: int = 10) -> Column:
    """Without chart and table data; only contents of more than `least` characters."""

    def tidy(s: Column) -> Column:
        return section(s["sectionTitle"], X.clean_table_data(X.clean_chart_data(s["sectionContent"]), s["sectionTitle"]))

    return F.filter(F.transform(sections, tidy), lambda s: F.length(s["sectionContent"]) > least)


def first_of_key(items: Column, key, always=None) -> Column:
    """The items of an array whose key none before has; those that `always` says stay anyhow."""
    pairs = F.transform(items, lambda x: F.struct(key(x).alias("k"), (F.lit(False) if always is None else always(x)).alias("stay"), x.alias("x")))

    def first(ps: Column) -> Column:
        return let(F.transform(ps, lambda p: p["k"]), lambda keys: F.filter(ps, lambda p, i: p["stay"] | (F.array_position(keys, p["k"]) == i + 1)))

    return F.transform(let(pairs, first), lambda p: p["x"])


def section_key(content: Column) -> Column:
    return F.substring(F.lower(X.strip(content)), 1, KEY)


def deduplicated(sections: Column) -> Column:
    return first_of_key(sections, lambda s: section_key(s["sectionContent"]), always=lambda s: section_key(s["sectionContent"]) == "")


def drop_empty(sections: Column) -> Column:
    return F.filter(sections, lambda s: X.strip(F.coalesce(s["sectionContent"], F.lit(""))) != "")


def dedup_rows(rows: DataFrame, doc: str, pos: str, content: str) -> DataFrame:
    """The same over exploded sections, for documents too long for one array: the first row of each key of a document."""
    key = section_key(F.col(content))
    first = F.row_number().over(Window.partitionBy(doc, "__key").orderBy(pos))
    return rows.withColumn("__key", key).withColumn("__n", first).filter("__n = 1 OR __key = ''").drop("__key", "__n")


#: Ends of a caption in a text, the first kind that occurs decides.
CAPTION_ENDS = ("\n\n", "\n", ". ", ".")


def without_caption(content: Column, part: Column) -> Column:
    """content without a caption part; where only its first characters occur, without what follows up to an end."""
    key = F.substring(part, 1, CAPTION_KEY)
    at = F.position(key, content)
    after = at + F.length(key)
    ends = [F.position(F.lit(e), content, after) for e in CAPTION_ENDS]
    stop = F.coalesce(*[F.when(p > 0, p + len(e)) for p, e in zip(ends, CAPTION_ENDS, strict=True)], F.length(content) + 1)
    cut = F.concat(F.left(content, at - 1), F.substr(content, stop))
    whole = F.replace(content, part, F.lit(""))
    return F.when(content.contains(part), X.strip(whole)).when(content.contains(key), X.strip(cut)).otherwise(content)


def without_captions(content: Column, parts: Column) -> Column:
    """content after all parts in turn; if one was found, lines of lone capitals and runs of empty lines go as well."""
    start = F.struct(content.alias("c"), F.lit(False).alias("hit"))

    def step(acc: Column, part: Column) -> Column:
        hit = acc["c"].contains(F.substring(part, 1, CAPTION_KEY))
        return F.struct(F.when(hit, without_caption(acc["c"], part)).otherwise(acc["c"]).alias("c"), (acc["hit"] | hit).alias("hit"))

    def finish(acc: Column) -> Column:
        lone = F.regexp_replace(acc["c"], r"(?mdU)^\s*[A-Z]\s+[A-Z](?:\s+[A-Z])*\s*$", "")
        return F.when(acc["hit"], X.strip(F.regexp_replace(lone, r"(?U)\n\s*\n\s*\n+", "\n\n"))).otherwise(acc["c"])

    return F.aggregate(parts, start, step, finish)


def caption_parts(captions: Column) -> Column:
    return F.filter(F.transform(F.flatten(F.transform(captions, lambda c: c["captions"])), X.strip), lambda p: p != "")


def remove_caption_text(sections: Column, captions: Column) -> Column:
    def removed(parts: Column) -> Column:
        out = F.transform(sections, lambda s: section(s["sectionTitle"], without_captions(s["sectionContent"], parts)))
        return F.when(F.size(parts) > 0, F.filter(out, lambda s: s["sectionContent"] != "")).otherwise(sections)

    return let(caption_parts(captions), removed)
