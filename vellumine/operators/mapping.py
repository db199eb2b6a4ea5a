"""From a document to the row of the metadata table, and to title and description."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.json_repair import read_object, storable
from vellumine.functions.text import strip
from vellumine.functions.udf import arrow
from vellumine.schema import METADATA

_KEPT_OUT = {"_validation", "validation_warnings", "error", "raw", "conference"}
_LISTS = {"subjects"}
_YEARS = {"publicationYear", "conferenceYear"}
#: Column and key in the conference object, by the names in use.
CONFERENCE = {
    "reference": {f"conference{k[0].upper()}{k[1:]}": k for k in "name location uri identifier identifierType startDate endDate acronym series".split()},
    "schema": {f"conference{k}": f"conference{k}" for k in "Name Location Uri Identifier IdentifierType Year StartDate EndDate Acronym Series".split()},
}
ROW = ", ".join(f"`{c}` {'array<string>' if c in _LISTS else 'bigint' if c in _YEARS else 'string'}" for c in METADATA if c != "posterId")


def one_or_text(values: list) -> str | None:
    """Nothing, the only element, or the list as text."""
    return json.dumps(values) if len(values) > 1 else (values[0] if values else None)


def _row(doc: dict, names: dict[str, str]) -> dict:
    out: dict = {}
    for k, v in doc.items():
        if k not in _KEPT_OUT and not k.startswith("_"):
            out[k] = v if k in _LISTS and isinstance(v, list) else json.dumps(v) if isinstance(v, (dict, list)) else v
    for many, one in (("sizes", "size"), ("formats", "format")):
        if isinstance(doc.get(many), list):
            out[one] = one_or_text(doc[many])
    out.setdefault("subjects", [])
    if isinstance(held := doc.get("conference"), dict):
        out |= {column: held.get(key) for column, key in names.items()}
    return out


def _whole(value: object) -> int | None:
    """A number that fits into 64 bits, as a whole one."""
    number = isinstance(value, (int, float)) and value == value and abs(value) < 2**63
    return int(value) if number else None


def metadata_row(document: Column, conference_keys: str = "reference") -> Column:
    """struct of all metadata columns but posterId; what is no JSON object has those of an empty one. conference_keys: 'reference' reads the short names, 'schema' those of the rules."""
    names = CONFERENCE[conference_keys]
    columns = [c for c in METADATA if c != "posterId"]

    @arrow(ROW)
    def run(documents: list[str | None]) -> list[tuple]:
        rows = []
        for d in documents:
            try:
                row = _row(read_object(d)[0], names)
            except RecursionError:  # nested too deeply to be written as text
                row = _row({}, names)
            text = lambda v: v if v is None else storable(v) if isinstance(v, str) else json.dumps(v)
            rows.append(tuple([text(x) for x in row[c]] if c in _LISTS and isinstance(row.get(c), list) else _whole(row.get(c)) if c in _YEARS else None if c in _LISTS else text(row.get(c)) for c in columns))
        return rows

    return run(document)


def size_text(values: Column) -> Column:
    """one_or_text of an array<string>."""
    return F.when(F.size(values) > 1, F.to_json(values)).when(F.size(values) == 1, F.element_at(values, 1))


def title_of(titles: Column) -> Column:
    """The first title that isn't empty. titles: array<struct<title>>."""
    return F.coalesce(strip(F.get(F.filter(titles, lambda t: F.coalesce(t["title"], F.lit("")) != ""), F.lit(0))["title"]), F.lit(""))


def description_of(descriptions: Column, sections: Column) -> Column:
    """The abstract, else the first description, else the first section that is called so (even if it is empty)."""
    some = F.filter(descriptions, lambda d: F.coalesce(d["description"], F.lit("")) != "")
    abstract = F.filter(some, lambda d: strip(F.coalesce(d["descriptionType"], F.lit(""))) == "Abstract")
    named = F.filter(sections, lambda s: F.lower(F.coalesce(s["sectionTitle"], F.lit(""))).contains("abstract"))
    first = lambda a, f: F.nullif(strip(F.get(a, F.lit(0))[f]), F.lit(""))
    return F.coalesce(first(abstract, "description"), first(some, "description"), first(named, "sectionContent"), F.lit(""))
