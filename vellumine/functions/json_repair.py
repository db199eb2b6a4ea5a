"""Parsing JSON that a model wrote: fences, junk around it, slips and cut ends.

The single-pattern repairs are column expressions too. Everything that must know strings from structure, and the ladder
of attempts, is one Arrow function a document.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.udf import arrow

#: Units after which a quote is part of the text.
UNITS = "pc km m cm mm Hz kHz MHz GHz s ms ns arcsec arcmin deg".split()
RAW = 3000
_UNIT = rf'(\d+\s*(?:{"|".join(UNITS)}))/"'
_UNIT_IN_BRACKETS = r'\((\d+\.?\d*\s*\w+)/"\)'
_COMMA = r",\s*([}\]])"
_BAD_ESCAPE = r"\\u[0-9a-fA-F]{0,3}(?![0-9a-fA-F])"
_CONTROL = r"[\x00-\x1f]"
#: A whole string (or an unfinished one), or a sign of structure.
_STRING = r'"(?:[^"\\]|\\.|\\\Z)*+(?:"|\Z)'
_STRUCTURE = re.compile(_STRING + r"|[{}]", re.S)
_STRUCTURE_ESCAPED = re.compile(r"\\.|\\\Z|" + _STRING + r"|[{}\[\]]", re.S)
#: What a cut text may end with before it is closed.
_NO_END = re.compile(r'[^{}\[\]"0-9trufalsen]+\Z')


def unfenced(c: Column) -> Column:
    """What stands in the first code fence, if it is closed."""
    out = c
    for mark in ("```", "```json"):  # the second one wins where both are there
        at = F.locate(mark, c)
        rest = F.substr(c, at + len(mark))
        end = F.locate("```", rest)
        body = F.when(end > 0, F.left(rest, end - 1)).otherwise(c)
        out = F.when(at > 0, body).otherwise(out)
    return out


def escape_unit_quotes(c: Column) -> Column:
    first = F.regexp_replace(c, "(?U)" + _UNIT, r'$1/\\"')
    return F.regexp_replace(first, "(?U)" + _UNIT_IN_BRACKETS, r'($1/\\")')


def drop_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + _COMMA, "$1")


def drop_bad_escapes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, _BAD_ESCAPE, ""), _CONTROL, " ")


def _quotes(s: str) -> str:
    return re.sub(_UNIT_IN_BRACKETS, r'(\1/\\")', re.sub(_UNIT, r'\1/\\"', s))


def _commas(s: str) -> str:
    return re.sub(_COMMA, r"\1", s)


def _escapes(s: str) -> str:
    return re.sub(_CONTROL, " ", re.sub(_BAD_ESCAPE, "", s))


def first_object(s: str) -> str:
    """Up to the brace that closes the first one; all of s if none does."""
    depth = 0
    for m in _STRUCTURE.finditer(s):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return s[: m.end()]
    return s


def close_cut(s: str) -> str:
    """Closes an open string, drops a tail that can't end a value, then closes brackets and, after them, braces."""
    s = _commas(s)
    open_ = {"{": 0, "[": 0}
    cut = False
    for m in _STRUCTURE_ESCAPED.finditer(s):
        sign = m[0]
        if sign in "{[":
            open_[sign] += 1
        elif sign in "}]":
            open_["{" if sign == "}" else "["] -= 1
        elif sign[0] == '"':
            cut = m.end() == len(s) and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', sign, re.S)
    if cut:
        s = s.rstrip()
        s += "" if s.endswith('"') else '"'
        if '"sectionContent":' in s[-1000:] or "sectionContent" in s[-500:]:
            open_["{"] += 1
    return _NO_END.sub("", s) + "]" * max(0, open_["["]) + "}" * max(0, open_["{"])


def _all(s: str) -> str:
    return close_cut(_commas(_escapes(_quotes(s))))


#: Tried in turn on the same text; the first that parses wins.
LADDER = (lambda s: s, _quotes, _commas, _escapes, close_cut, _all, lambda s: _all(_quotes(s)))


_LONE = re.compile("[\ud800-\udfff]")


def dumped(value: object) -> str:
    """JSON text without escapes, but for halves of surrogate pairs: these have no UTF-8, so they stay escaped."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


def read_object(text: str | None) -> tuple[dict, str | None]:
    """A JSON object and None, or an empty one and what is wrong. No text at all is an empty object."""
    try:
        value = json.loads(text) if text else {}
    except (ValueError, RecursionError) as e:
        return {}, f"not readable as JSON: {type(e).__name__}"
    return (value, None) if isinstance(value, dict) else ({}, "not a JSON object")


def storable(text: str) -> str:
    """A text with a replacement sign for each half of a surrogate pair."""
    return _LONE.sub("\ufffd", text)


def attempt(response: str) -> tuple[dict | None, str | None, str | None]:
    """(object, None, None), or (None, error, raw)."""
    found, _, error, raw = _attempt(response)
    return found, error, raw


def _attempt(response: str) -> tuple[dict | None, str | None, str | None, str | None]:
    """(object, its text, None, None), or (None, None, error, raw). A repair that changes nothing since the last try isn't parsed again."""
    s = response.strip()
    for mark in ("```json", "```"):
        if mark in s:
            body, closed, _ = s.partition(mark)[2].partition("```")
            s = body if closed else s
            break
    s = s.strip()
    if "{" not in s:
        return None, None, "No JSON found", s[:RAW]
    s = first_object(_quotes(s[s.index("{") :]))
    tried = set()
    for repair in LADDER:
        try:
            if (repaired := repair(s)) in tried:
                continue
            tried.add(repaired)
            found = json.loads(repaired)
            return found, dumped(found), None, None  # what is nested too deep to be written counts as not parsed
        except (ValueError, RecursionError):
            continue
    return None, None, "JSON parse failed", s[:RAW]


def parse(response: str) -> dict:
    """The object in a response, or {"error", "raw"}."""
    found, error, raw = attempt(response)
    return {"error": error, "raw": raw} if found is None else found


@arrow("struct<value:string,error:string,raw:string>")
def parse_json(responses: list[str | None]) -> list[tuple[str | None, str | None, str | None]]:
    """value: the object as canonical JSON, null on error; a null response is an empty one. An object that has a key "error" is a value."""
    return [_attempt(r or "")[1:] for r in responses]
