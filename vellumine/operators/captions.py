"""Captions in their historical shapes, as one: array<struct<captions array<string>>>.

Shapes of the JSON text: a list, or an object with a list under "captions"; an element holds its parts under "captions",
under "captionParts", or under keys that begin with "caption", which then go in lexical order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions import text as X
from vellumine.operators.sections import CAPTION_KEY, CAPTIONS, first_of_key


def normalized(captions: Column) -> Column:
    """Blank parts and empty captions left out; of captions with the same beginning the first."""
    parts = F.transform(F.coalesce(captions, F.array().cast(CAPTIONS)), lambda c: F.filter(F.transform(F.coalesce(c["captions"], F.array().cast("array<string>")), X.strip), lambda p: p != ""))
    full = F.filter(parts, lambda p: F.size(p) > 0)
    first = first_of_key(full, lambda p: F.substring(F.lower(F.get(p, F.lit(0))), 1, CAPTION_KEY))
    return F.transform(first, lambda p: F.struct(p.alias("captions")))


def _strings(values: Column) -> Column:
    """The strings of an array<variant>; what is no string is left out."""
    return F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))


def _list(json: Column, key: str) -> Column:
    """The strings of the list under a key, null if there is none."""
    at = F.get_json_object(json, f"$.{key}")
    return F.when(at.startswith("["), _strings(F.from_json(at, "array<variant>")))


def _element(e: Column) -> Column:
    keys = F.filter(F.array_sort(F.json_object_keys(e)), lambda k: k.startswith("caption"))
    values = F.from_json(e, "map<string,variant>")
    legacy = _strings(F.transform(keys, lambda k: values[k]))
    has = lambda key: F.array_contains(F.json_object_keys(e), key)
    none = F.array().cast("array<string>")
    kept = F.when(_list(e, "captions").isNotNull(), _list(e, "captions")).when(has("captionParts"), F.coalesce(_list(e, "captionParts"), none)).otherwise(legacy)
    return F.struct(kept.alias("captions"))


def from_shapes(json: Column) -> Column:
    """Captions of any shape, normalised. What is no list of objects has none."""
    inner = F.when(json.startswith("{"), F.get_json_object(json, "$.captions")).otherwise(json)
    listed = F.when(inner.startswith("["), F.from_json(inner, "array<string>"))
    objects = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda e: e.isNotNull() & e.startswith("{"))
    return normalized(F.transform(objects, _element))
