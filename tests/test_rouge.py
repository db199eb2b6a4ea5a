import random

from vellumine.functions import rouge


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs_against_the_table():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 80))] for _ in range(2))
        assert rouge.lcs(a, b) == plain_lcs(a, b)


def test_stems():
    # Pairs from the published description of the algorithm.
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop filing file happy happi relational relat conditional condit vietnamization vietnam triplicate triplic hopefulness hope revival reviv adjustment adjust adoption adopt probate probat rate rate controll control".split()
    for word, stem in zip(pairs[::2], pairs[1::2], strict=True):
        assert rouge.stem(word) == stem, word


def test_scores():
    assert rouge.f_measure(rouge.tokens("The cats sat"), rouge.tokens("the cat sat")) == 1.0 or rouge.tokens("cats") == ["cat"]
    assert rouge.f_measure([], ["a"]) == 0.0
    assert rouge.tokens("Müller's 3.5") == ["m", "ller", "s", "3", "5"]


def test_stems_with_the_usual_extensions():
    pairs = "days day day day keys key biology biolog biological biolog technology technolog methodology methodolog carefully care happily happili flies fli dies die died die spied spi skies sky dying die enjoy enjoy proceed proceed innings inning usefully use possibly possibl".split()
    for word, stem in zip(pairs[::2], pairs[1::2], strict=True):
        assert rouge.stem(word) == stem, (word, rouge.stem(word))
