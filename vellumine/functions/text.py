"""Text cleaning as column expressions. Python's notions of white space, digits and letters, in Java patterns: (?U)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.bind import let
from vellumine.functions.udf import arrow

_SPACE = r"\s\x1C-\x1F"
#: Invisible characters that are deleted; spaces that become plain ones.
INVISIBLE = "[\u200e\u200f\u202a-\u202e\u2066-\u2069\u200b-\u200d\ufeff\u00ad]"
ODD_SPACES = "[\u00a0\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: White space of any script.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.btrim(c, F.lit(WHITE))


def clean_unicode(c: Column) -> Column:
    """No invisible marks, plain spaces, one at a time; lines stay. Most texts have nothing to clean, which one look tells."""

    def cleaned(t: Column) -> Column:
        spaced = F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), ODD_SPACES, " ")
        return strip(F.when(t.rlike(f"{INVISIBLE}|{ODD_SPACES}|  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(t))

    return let(c, cleaned)


def first_sentence(c: Column) -> Column:
    return strip(F.element_at(F.split(c, r"(?U)(?<=[.!?])\s+"), 1))


#: What counts as axis labels or runs of numbers.
NUMBER = r"-?\d++\.?+\d*+"
TRIPLE = rf"(?U)(?:^|\s){NUMBER}\s+{NUMBER}\s+{NUMBER}"
AXIS = [r"vs\s+expression\s+Relative", r"Relative\s+\*?\s*\*?", r"-CTRL\s+vs\s+expression", r"progenitor\s+CD\d+\s+vs", r"\d+\s+\d+\s+\d+\s+\d+\s+\d+"]
AXIS_LINE = (r"vs\s+expression|Relative\s+\*", r"\d\.\d++\s++\d++\.\d")
#: Of the fourth, only the two words on each side of the line end decide.
TABLE = [r"Reason\s+Participant\s*\(n=\d+\)", r"(?:Column\s+\d+|Row\s+\d+)", r"\|\s*\w+\s*\|", r"\w\s+\w+\s+\n\w+\s+\w+\s"]
NOT_A_SUMMARY = r"^(Reason|Participant|Example)"


def has_chart_data(c: Column) -> Column:
    """The patterns are slow, so what each of them needs is looked for first."""

    def has(t: Column) -> Column:
        low, digits = F.lower(t), t.rlike(r"\p{Nd}")
        worded = [(low.contains("relative"), AXIS[1]), (low.contains("expression"), f"{AXIS[0]}|{AXIS[2]}"), (low.contains("progenitor"), AXIS[3])]
        numbers = digits & (t.rlike(r"(?U)\d++\s++\d++\s++\d++\s++\d++\s++\d") | (F.regexp_count(t, F.lit(TRIPLE)) >= 5))
        for there, pattern in worded:
            numbers = numbers | (there & t.rlike("(?iU)" + pattern))
        return numbers

    return let(c, has)


def clean_chart_data(c: Column) -> Column:
    """Lines that read like sentences, joined; else the first long sentence without numbers in rows; else the text as it is."""

    def reads(line: Column) -> Column:
        letters = F.length(F.regexp_replace(line, "[^a-zA-Z]++", ""))
        signs = F.length(line) - F.length(F.regexp_replace(line, r"(?U)[\d.\-*]++", ""))
        low = F.lower(line)
        worded = (low.contains("expression") | low.contains("relative")) & line.rlike("(?iU)" + AXIS_LINE[0])
        return (F.length(line) > 30) & (letters > signs) & ~(worded | line.rlike("(?U)" + AXIS_LINE[1]))

    lines = F.filter(F.transform(F.split(c, "\n"), strip), reads)
    joined = F.regexp_replace(F.array_join(lines, " "), r"(?U)(?:\s++-?\d++\.?+\d*+){5,}+", "")
    kept = strip(F.regexp_replace(joined, r"(?U)\s{2,}", " "))
    long = F.filter(F.split(c, r"(?U)(?<=[.!?])\s+"), lambda s: (F.length(s) > 50) & ~has_chart_data(s))
    other = F.when(F.size(long) > 0, strip(F.get(long, F.lit(0)))).otherwise(c)
    return F.when(has_chart_data(c), F.coalesce(F.nullif(kept, F.lit("")), other)).otherwise(c)


def has_table_data(c: Column) -> Column:
    likely = c.contains("\n") | c.contains("|") | c.rlike(r"\p{Nd}")
    return F.when(likely, c.rlike("(?iU)" + "|".join(TABLE))).otherwise(F.when(c.isNotNull(), False))


def clean_table_data(c: Column, title: Column) -> Column:
    """Of results and findings only the first sentence, if it is one."""

    def shortened(t: Column) -> Column:
        first = first_sentence(t)
        summed = (title.contains("Results") | title.contains("Findings")) & (F.length(first) > 20) & ~first.rlike(NOT_A_SUMMARY)
        return F.when(summed & has_table_data(t), first).otherwise(t)

    return let(c, shortened)


#: Fixed values for comparison of texts.
_SPACES = "\u00a0" + "".join(chr(x) for x in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"
_SINGLE, _DOUBLE, _DASHES = "‛′‹›‚‟", "„«»〝〞〟＂", "‐‑‒–—―−"
_SUPER, _SUB = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"


@arrow("string")
def nfkd(texts: list[str | None]) -> list[str | None]:
    return [t and unicodedata.normalize("NFKD", t) for t in texts]


def normalize(c: Column, legacy_comma_quirk: bool = True) -> Column:
    """A text for comparison: plain spaces, quotes, dashes and digits, then compatibility decomposition.

    legacy_comma_quirk: a comma and a space become an apostrophe, so the words around it run together later on."""
    spaced = F.translate(c, _SPACES, " " * len(_SPACES))
    quoted = F.replace(spaced, F.lit(", "), F.lit("'")) if legacy_comma_quirk else spaced
    origin = _SINGLE + _DOUBLE + _DASHES + _SUPER + _SUB
    target = "'" * len(_SINGLE) + '"' * len(_DOUBLE) + "-" * len(_DASHES) + "0123456789" * 2
    return nfkd(F.translate(quoted, origin, target))


def alphanumeric(c: Column) -> Column:
    """Letters and digits of ASCII in lower case, words one space apart."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(c, rf"(?U)[^a-zA-Z0-9{_SPACE}]", ""), rf"(?U)[{_SPACE}]+", " ")))


def word_set(c: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(alphanumeric(c), " ")), "")


def number_set(c: Column) -> Column:
    """Distinct numbers, as written, that are likely content: with a point, below 1,000, or below 100,000 and no year from 2010 to 2030."""

    def content(n: Column) -> Column:
        value = F.coalesce(n.try_cast("double"), F.lit(0.0))
        return n.contains(".") | (value < 1000) | ((value < 100000) & ~value.between(2010, 2030))

    return F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\d+\.?\d*"), F.lit(0))), content)


def is_truncated(c: Column) -> Column:
    """More open than closed braces or brackets, or an end that can't be one."""
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return (count("{") > count("}")) | (count("[") > count("]")) | c.rlike(rf'(?U)[,:"][{_SPACE}]*\z')
