"""Checks of documents against the rules: violations are rows of warnings, never a rejection; then defaults."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.json_repair import dumped, read_object, storable
from vellumine.functions.udf import arrow
from vellumine.schema import DEFAULTS, RULES

#: The version that results name.
SCHEMA_VERSION = "extraction-v0.1"
WARNINGS = "array<struct<field:string,issue:string,message:string,auto_fixed:boolean>>"
_TYPES = {"string": str, "array": list, "object": dict}


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return isinstance(value, _TYPES[kind])


def violations(value: object, rule: dict, path: tuple = ()) -> Iterator[tuple[tuple, str, object, object]]:
    """(path, broken rule, what it asks for, value), in the order of the rules; a required field that is missing counts each for itself."""
    for name, asked in rule.items():
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if name == "properties" and isinstance(value, dict):
            for key, inner in asked.items():
                if key in value:
                    yield from violations(value[key], inner, (*path, key))
        elif name == "items" and isinstance(value, list):
            for i, item in enumerate(value):
                yield from violations(item, asked, (*path, i))
        elif name == "required" and isinstance(value, dict):
            yield from ((path, name, asked, value) for key in asked if key not in value)
        elif (
            (name == "type" and not _is(value, asked))
            or (name == "minItems" and isinstance(value, list) and len(value) < asked)
            or (name == "minLength" and isinstance(value, str) and len(value) < asked)
            or (name == "minimum" and number and value < asked)
            or (name == "maximum" and number and value > asked)
            or (name == "enum" and value not in asked)
        ):
            yield path, name, asked, value


def warning(path: tuple, name: str, asked: object, value: object) -> tuple[str, str, str] | None:
    """(field, issue, message), or None for what is no warning."""
    at = ".".join(map(str, path)) or "root"
    if name == "minItems":
        return (at, "empty_required_array", f"Required field '{at}' is empty - extraction may have failed") if path in (("creators",), ("titles",)) else None
    if name == "required":
        return at, "missing_required", f"Missing required field(s) at '{at}': {', '.join(f for f in asked if f not in value)}"
    said = {
        "minLength": ("empty_string", f"Field '{at}' has empty string value"),
        "type": ("wrong_type", f"Field '{at}' has wrong type: expected {asked}"),
        "enum": ("invalid_enum", f"Invalid value at '{at}': must be one of {asked}"),
    }
    return (at, *said[name]) if name in said else None


@arrow(f"struct<document:string,valid:boolean,errors_count:int,warnings_count:int,filled_fields:array<string>,warnings:{WARNINGS}>")
def validate(documents: list[str | None]) -> list[tuple]:
    """document: with its check results and defaults. Objects with an error come back as they are, without counts; what is no object becomes one that says so, with
    the text as `raw`."""
    rows = []
    for d in documents:
        doc, wrong = read_object(d)
        if wrong:
            rows.append((dumped({"error": wrong, "raw": d}), None, None, None, [], []))
            continue
        if "error" in doc:
            rows.append((d, None, None, None, [], []))
            continue
        try:
            broken = list(violations(doc, RULES))
            dumped(doc)
        except RecursionError:
            rows.append((dumped({"error": "nested too deeply", "raw": d}), None, None, None, [], []))
            continue
        told = [tuple(map(storable, w)) for v in broken if (w := warning(*v))]
        filled = [k for k in DEFAULTS if k not in doc]
        checked = {"schema_version": SCHEMA_VERSION, "valid": not broken, "warnings_count": len(told), "errors_count": len(broken), "filled_fields": filled}
        whole = {**doc, "_validation": checked, **{k: DEFAULTS[k] for k in filled}}
        rows.append((dumped(whole), not broken, len(broken), len(told), filled, [{"field": f, "issue": i, "message": m, "auto_fixed": False} for f, i, m in told]))
    return rows


def missing_fields(document: Column, fields: list[str]) -> Column:
    """Those of the fields that a JSON object has no key for; null counts as there."""
    keys = F.json_object_keys(document)
    return F.filter(F.array(*map(F.lit, fields)), lambda f: ~F.array_contains(keys, f))


def filled(document: Column, defaults: dict[str, str]) -> Column:
    """A flat JSON object of strings with missing keys filled."""
    have = F.from_json(document, "map<string,string>")
    missing = F.map_from_entries(F.transform(missing_fields(document, list(defaults)), lambda f: F.struct(f, F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])[f])))
    return F.map_concat(have, missing)


def rule_warnings(checks: list[tuple[Column, str, str, str]]) -> Column:
    """Warnings of typed rows: (broken, field, issue, message) each."""
    each = [F.when(broken, F.struct(F.lit(f).alias("field"), F.lit(i).alias("issue"), F.lit(m).alias("message"), F.lit(False).alias("auto_fixed"))) for broken, f, i, m in checks]
    return F.array_compact(F.array(*each))
