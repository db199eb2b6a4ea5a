"""The rules as one column expression over a VARIANT: the same errors and warnings as `validation.violations`, without Python.

The rule tree is walked once, when the expression is built; what it leaves in the plan are path reads, type tests and
transforms of arrays. A text counts as parsed if it is one whole JSON value for the JVM's parser. What only Python's reads (NaN,
repeated keys, nesting beyond a thousand) is left to `validation.validate`: see `checked`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.bind import let
from vellumine.operators.validation import WARNINGS, validate
from vellumine.schema import RULES

_ERRORS = "array<struct<field:string,issue:string,message:string>>"
#: Arrays whose emptiness is told as a warning; other broken rules without an entry in `_SAID` only count as errors.
_TOLD_EMPTY = (("creators",), ("titles",))


def whole_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value with nothing behind it, else null. The parser stops at the end of a value, so
    the text is read as the first of two elements, the second its hash: only where both are found was all of it read."""
    mark = F.xxhash64(text)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    ends = F.try_variant_get(both, "$[1]", "bigint").eqNullSafe(mark) & F.try_variant_get(both, "$[2]", "variant").isNull()
    return F.when(ends, F.try_variant_get(both, "$[0]", "variant"))


def _number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _is(value: Column, kind: Column, asked: str) -> Column:
    if asked == "integer":
        return (kind == "BIGINT") | _number(kind) & (F.try_variant_get(value, "$", "double") % 1 == 0)
    return {"string": kind == "STRING", "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT")}[asked]


def _said(name: str, asked: object, at: Column) -> tuple[str, Column] | None:
    """(issue, message) of a broken rule that is told as a warning."""
    return {
        "minLength": ("empty_string", F.concat(F.lit("Field '"), at, F.lit("' has empty string value"))),
        "type": ("wrong_type", F.concat(F.lit("Field '"), at, F.lit(f"' has wrong type: expected {asked}"))),
        "enum": ("invalid_enum", F.concat(F.lit("Invalid value at '"), at, F.lit(f"': must be one of {asked}"))),
        "minItems": ("empty_required_array", F.concat(F.lit("Required field '"), at, F.lit("' is empty - extraction may have failed"))),
    }.get(name)


def _error(at: Column, issue: str | None, message: Column | None) -> Column:
    return F.struct(at.alias("field"), F.lit(issue).cast("string").alias("issue"), (F.lit(None).cast("string") if message is None else message).alias("message"))


def errors(value: Column, rule: dict, path: tuple = (), at: Column | None = None) -> Column:
    """field, issue, message of each broken rule, in the order of the rules; issue is null for what is no warning. value: a VARIANT
    that is there. path: names, None for a place in an array; at: the same as text."""
    none = F.array().cast(_ERRORS)
    shown = F.lit("root") if at is None else at
    inner = lambda name: name if at is None else F.concat(at, F.lit("."), name)
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(value, "$", "array<variant>")
    number = F.when(_number(kind), F.try_variant_get(value, "$", "double"))
    string = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    parts = []
    for name, asked in rule.items():
        if name == "properties":
            for key, below in asked.items():
                held = F.try_variant_get(value, f"$.{key}", "variant")
                parts.append(let(held, lambda h: F.when(h.isNotNull(), errors(h, below, (*path, key), inner(F.lit(key)))).otherwise(none)))
        elif name == "items":
            each = F.transform(items, lambda x, i: errors(x, rule["items"], (*path, None), inner(i.cast("string"))))
            parts.append(F.coalesce(F.flatten(each), none))
        elif name == "required":
            absent = F.array_compact(F.array(*[F.when(F.try_variant_get(value, f"$.{key}", "variant").isNull(), F.lit(key)) for key in asked]))
            told = F.concat(F.lit("Missing required field(s) at '"), shown, F.lit("': "), F.array_join(absent, ", "))
            parts.append(F.when(kind.startswith("OBJECT"), F.array_repeat(_error(shown, "missing_required", told), F.size(absent))).otherwise(none))
        else:
            broken = {
                "type": lambda: ~_is(value, kind, asked),
                "minItems": lambda: F.size(items) < asked,
                "minLength": lambda: F.length(string) < asked,
                "minimum": lambda: number < asked,
                "maximum": lambda: number > asked,
                "enum": lambda: ~F.coalesce(string.isin(asked), F.lit(False)),
            }[name]()
            said = None if name == "minItems" and path not in _TOLD_EMPTY else _said(name, asked, shown)
            parts.append(F.when(F.coalesce(broken & (items.isNotNull() if name == "minItems" else F.lit(True)), F.lit(False)), F.array(_error(shown, *(said or (None, None))))).otherwise(none))
    return F.concat(*parts)


def checks(document: Column, rules: dict = RULES) -> Column:
    """parsed, valid, errors_count, warnings_count, warnings of a JSON text. Counts are null and warnings empty for what is no object,
    what has an error, and what was not parsed."""
    def judged(parsed: Column) -> Column:
        is_open = F.schema_of_variant(parsed).startswith("OBJECT") & F.try_variant_get(parsed, "$.error", "variant").isNull()
        return let(F.when(is_open, errors(parsed, rules)), lambda e: let(F.filter(e, lambda x: x["issue"].isNotNull()), lambda w: result(parsed.isNotNull(), e, w)))

    def result(parsed: Column, e: Column, w: Column) -> Column:
        told = F.transform(w, lambda x: F.struct(x["field"].alias("field"), x["issue"].alias("issue"), x["message"].alias("message"), F.lit(False).alias("auto_fixed")))
        counts = [F.when(e.isNotNull(), c).alias(name) for c, name in ((F.size(e) == 0, "valid"), (F.size(e), "errors_count"), (F.size(w), "warnings_count"))]
        return F.struct(parsed.alias("parsed"), *counts, F.coalesce(told, F.array().cast(WARNINGS)).alias("warnings"))

    return let(whole_json(document), judged)


def checked(df: DataFrame, document: str = "document", name: str = "checks") -> DataFrame:
    """df with the checks (valid, errors_count, warnings_count, warnings) of its documents: in the JVM where it can read them, else by Python, to
    which the others go as nulls."""
    taken = df.withColumn("__c", checks(F.col(document)))
    slow = validate(F.when(~F.col("__c.parsed"), F.col(document)))
    names = ["valid", "errors_count", "warnings_count", "warnings"]
    both = taken.withColumn("__s", slow)
    return both.withColumn(name, F.when(F.col("__c.parsed"), F.struct(*[F.col(f"__c.{c}").alias(c) for c in names])).otherwise(F.struct(*[F.col(f"__s.{c}").alias(c) for c in names]))).drop("__c", "__s")
