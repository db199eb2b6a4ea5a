"""The string kernel against enumerated subsequences, its landmarks and folding, and held-out documents."""

import os
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumine.llm import toxicity, words
from vellumine.llm.queries import op1_string_kernel_toxicity


def unit(word):
    return bytes(ord(x) - 96 for x in word)


def plain_kernel(x, y):
    """Over all subsequences of three letters within 8 places and five within 7, ends included."""
    total = 0.0
    for n, span, _ in toxicity.ORDERS:
        weights = []
        for w in (x, y):
            framed, found, norm = f"<{w}>", {}, 0.0
            for at in combinations(range(len(framed)), n):
                if at[-1] - at[0] < span:
                    key = "".join(framed[i] for i in at)
                    found[key] = found.get(key, 0.0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
            # Divided by the root of the summed squared weights of as many different subsequences as the length has places for.
            norm = sum(max(len(framed) - s[-1], 0) * toxicity.DECAY ** (2 * (s[-1] + 1)) for s in combinations(range(span), n) if s[0] == 0)
            norm = max(norm, toxicity.DECAY ** (2 * n)) ** 0.5
            weights.append({k: v / norm for k, v in found.items()})
        total += sum(v * weights[1].get(k, 0.0) for k, v in weights[0].items())
    return total


WORDS = ["moron", "moroxn", "table", "aa", "a", "scoundrel", "scscoundrel", "banana", "notabene"]


def test_kernel_is_the_sum_over_subsequences():
    land = toxicity.Landmarks([unit(w) for w in WORDS])
    got = land.kernel([unit(w) for w in WORDS])
    want = np.array([[plain_kernel(x, y) for y in WORDS] for x in WORDS])
    assert np.abs(got - want).max() < 1e-9
    assert want[0, 1] > 0.4 * want[0, 0] > 5 * want[0, 2]


def test_folded_weights_give_the_kernel_machine():
    r = np.random.default_rng(3)
    marks = [unit(w) for w in WORDS]
    land = toxicity.Landmarks(marks)
    weight = r.standard_normal(len(marks))
    machine = toxicity.Machine([(known, table @ weight) for known, table in land.tables], 0.25, np.zeros(toxicity.BINS), 1.0, 0.0)
    some = [unit("".join(r.choice(list("abcdmorn"), r.integers(1, 12)))) for _ in range(50)]
    assert np.abs(machine.margins(*toxicity._flat(some)) - (land.kernel(some) @ weight + 0.25)).max() < 1e-5
    long = unit("xyz" * 10 + "moron" + "zyx" * 10)  # the best of its windows
    windows = [long[i : i + 14] for i in range(len(long) - 13)]
    assert machine.margins(*toxicity._flat([long]))[0] > -10 and len(windows) > 50


def test_held_out_documents_and_disguises():
    r = random.Random(15)
    word = lambda: "".join(r.choices(["an", "the", "or", "ing", "ti", "es", "wh"], k=r.randint(1, 4)))
    text = lambda bad: " ".join([*(word() for _ in range(60)), *(r.choices(("scoundrel", "dimwit", "vermin"), k=3) if bad else []), *(word() for _ in range(60))])
    machine = toxicity.fit([text(True) for _ in range(100)], [text(False) for _ in range(200)])
    score = lambda texts: machine.probability(toxicity.Scorer(machine).counted(pa.array(texts)))
    assert (score([text(True) for _ in range(100)]) >= 0.7).mean() >= 0.98
    assert (score([text(False) for _ in range(300)]) >= 0.7).mean() <= 0.01
    assert (score(["the s c o u n d r e l is", "a dim.wit", "the vermxin or", "a sscoundrel", "Dimw1t"]) >= 0.5).mean() >= 0.8
    assert (score(["the s c o u n d r e l is a dim.wit", "the vermxin or a sscoundrel", "Dimw1t, v.e.r.m.i.n"]) >= 0.5).all()
    assert score([""])[0] <= 0.5


def test_few_documents_with_words_of_one_stem():
    """Twelve toxic documents, whose insults are different words of two stems."""
    r = random.Random(7)
    parts = ["ga", "lo", "mi", "ren", "tu", "sal", "ve", "po", "ki", "dor"]
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 3)))
    bad = lambda: r.choice(("zwurf", "knaxel")) + r.choice(parts)
    text = lambda toxic: " ".join([word(), *(bad() if toxic and i % 30 == 7 else word() for i in range(120))])
    machine = toxicity.fit([text(True) for _ in range(12)], [text(False) for _ in range(80)])
    score = lambda texts: machine.probability(toxicity.Scorer(machine).counted(pa.array(texts)))
    assert (score([text(True) for _ in range(60)]) >= 0.7).mean() >= 0.95
    assert (score([text(False) for _ in range(200)]) >= 0.7).mean() <= 0.01


def test_long_texts_are_counted_whole(monkeypatch):
    r = random.Random(8)
    some = lambda n: " ".join("".join(r.choices("abcdefg", k=4)) for _ in range(n))
    machine = toxicity.fit([f"{some(5)} scoundrel {some(5)}" for i in range(30)], [f"{some(5)} person {some(5)}" for i in range(60)])
    text = " ".join(r.choices(["an", "kind", "scoundrel", "person", "by", "to", "of"], k=3000))
    whole = toxicity.Scorer(machine).counted(pa.array([text]))
    monkeypatch.setattr(words, "PIECE", 100)
    assert words.is_long(pa.array([text]), 0, 1)
    monkeypatch.setattr(toxicity, "pieces", lambda texts: iter([(0, 1)]))
    monkeypatch.setattr(toxicity, "long_text", lambda t, table, shared: words.long_text(t, table, shared, 500))
    parts = toxicity.Scorer(machine).counted(pa.array([text]))
    # The last unit of a part has none behind it there: one pair more at most for a part.
    assert np.abs(parts - whole).sum() <= len(text) / 500 + 1 and whole.sum() > 20


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_documents_of_the_tables(spark, sf):
    """Labels are noisy: about one in sixteen of the documents that are labelled toxic has no insult at all."""
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables aren't here")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = op1_string_kernel_toxicity(spark, folder).join(labels, "doc_id").groupBy("held_out", "toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {(r.held_out, r.toxic): r.p for r in got}
    assert share[True, 1] >= 0.88 and share[True, 0] <= 0.01 and share[False, 1] >= 0.85 and share[False, 0] <= 0.01
