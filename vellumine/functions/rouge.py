"""ROUGE-L (Lin 2004): F-measure of the longest common subsequence of stemmed tokens.

Tokens are lower-cased runs of a-z and 0-9; those over three letters are stemmed (Porter 1980, with the extensions that
are usual in language tool kits). The subsequence is found bit-parallel over Python integers (Hyyro 2004).
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import functions as F

from vellumine.functions.udf import arrow

#: Fixed values of the stemming algorithm: ending and what replaces it.
STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble bli:ble fulli:ful logi:log".split())
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


#: Words with stems of their own.
IRREGULAR = dict(x.split(":") for x in "skies:sky sky:sky dying:die lying:lie tying:tie news:news innings:inning inning:inning outings:outing outing:outing cannings:canning canning:canning howe:howe proceed:proceed exceed:exceed succeed:succeed".split())


def _shape(word: str) -> str:
    """c and v for each letter: y is a vowel behind a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or x == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(word: str) -> bool:
    shape = _shape(word)
    return shape[-3:] == "cvc" and word[-1] not in "wxy" or shape == "vc"


def _swapped(word: str, endings: dict[str, str], least: int) -> str:
    for end in sorted(endings, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            counted = word[:-3] if end == "logi" else stem
            return stem + endings[end] if _measure(counted) > least else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    for end, new in (("sses", "ss"), ("ies", "ie" if len(word) == 4 else "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: -len(end)] + new
            break
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (m := re.fullmatch("(.+?)(ed|ing)", word)) and "v" in _shape(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-1] == word[-2:-1] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    word = _swapped(_swapped(word, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short(rest):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def tokens(text: str) -> list[str]:
    return [stem(t) if len(t) > 3 else t for t in re.findall("[a-z0-9]+", text.lower())]


def lcs(a: list[str], b: list[str]) -> int:
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & every
    return (every ^ row).bit_count()


def f_measure(reference: list[str], generated: list[str]) -> float:
    if not reference or not generated:
        return 0.0
    n = lcs(reference, generated)
    if not n:
        return 0.0
    p, r = n / len(generated), n / len(reference)
    return 2 * p * r / (p + r)


@arrow("double")
def rouge_l(reference: list[str | None], generated: list[str | None]) -> list[float]:
    return [f_measure(tokens(r or ""), tokens(g or "")) for r, g in zip(reference, generated, strict=True)]


@arrow("struct<lcs:long,n_reference:long,n_generated:long>")
def rouge_counts(reference: list[str | None], generated: list[str | None]) -> list[tuple[int, int, int]]:
    """The whole numbers that the score is made of."""
    rows = []
    for r, g in zip(reference, generated, strict=True):
        a, b = tokens(r or ""), tokens(g or "")
        rows.append((lcs(a, b), len(a), len(b)))
    return rows
