"""Phrases against a plain count of all word sequences."""

import random
import re

import pytest

from vellumine.llm import phrases

KIND = "doc_id bigint, text string, lang string, phrase string, n string, k string, `a.b` string"


def plain_counts(rows, longest):
    counts, words_ = {}, {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words_[lang] = words_.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    return counts, words_


def plain_collocations(rows, longest, least, top):
    counts, words_ = plain_counts(rows, longest)
    often = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            gone |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * a >= 50 * often[lang, w[i : i + k]]}
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], k))
    return sorted((lang, i + 1, p.decode(), -a, k, left, right, words_[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right, k) in enumerate(sorted(found)[:top]))


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["a", "A", "bé", "c,", "d.", "é f", "g\nh", "i\tj", "K", "l" * 90, "m;n", "", "😀"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 60))), r.choice(("en", "en", "en", "fr", "", None))) for i in range(300)]
    return rows + [(None, None, None), (1, "", "en"), (1, "one two. one two", "xx"), *rows[:40]]


@pytest.mark.parametrize("fp_bits, longest, piece", [(64, 3, 1 << 20), (7, 3, 1 << 20), (64, 5, 1 << 20)])
def test_collocations(spark, fp_bits, longest, piece):
    """Also with fingerprints that collide all the time."""
    rows = corpus(longest)
    docs = spark.createDataFrame([(*x, "p", "n", "k", "z") for x in rows], KIND).repartition(3)
    got = phrases.collocations(docs, longest=longest, least=4, top=40, bits=8, fp_bits=fp_bits).collect()
    assert sorted(tuple(x)[:-1] for x in got) == plain_collocations(rows, longest, 4, 40)
    text = {(i, "und" if lang is None else lang): re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for i, t, lang in rows}
    for x in got:  # the example has the phrase
        if x.example is not None and (x.example, x.lang) in text and x.example != 1:
            assert x.phrase.replace(" ", "") in re.sub("[ \t]", "", text[x.example, x.lang])


def test_long_texts_in_parts(monkeypatch):
    import pyarrow as pa

    from vellumine.llm import words

    r = random.Random(9)
    text = " ".join(r.choices(["one", "two,", "é", "x" * 30, "three"], k=700))
    whole = {k: sorted(s.prints(s.places(k), k).tolist()) for *_, s, _ in phrases._parts(pa.RecordBatch.from_pydict({"text": [text], "lang": ["en"]}), 3, 64) for k in (1, 2, 3)}
    monkeypatch.setattr(words, "PIECE", 1)
    monkeypatch.setattr(words.long_text, "__defaults__", (64,))
    parts = {1: [], 2: [], 3: []}
    n = 0
    for *_, s, _ in phrases._parts(pa.RecordBatch.from_pydict({"text": [text], "lang": ["en"]}), 3, 64):
        n += 1
        for k in parts:
            parts[k] += s.prints(s.places(k), k).tolist()
    assert n > 10 and {k: sorted(v) for k, v in parts.items()} == whole


def test_scores_beyond_64_bits(spark):
    kind = "lang string, k int, phrase string, n bigint, example bigint"
    n = 4_000_000_000_003
    found = spark.createDataFrame([("en", 0, "", 3 * n, None), ("en", 1, "a", n + 7, 1), ("en", 1, "b", n + 9, 1), ("en", 2, "a b", n, 1)], kind)
    got = phrases.scored(found).collect()
    assert [(x.score, x.a, x.l, x.r, x.n) for x in got] == [(10**6 * n * n // ((n + 7) * (n + 9)), n, n + 7, n + 9, 3 * n)]


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], KIND)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "p", "n", "k", "z")], KIND)).count() == 0
