"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, with Nystroem landmarks.

Units. A text is cut at white space; of each word only letters and digits count, digits and signs that stand in for
letters become those letters, and three or more letters that stand alone in a row make one more word (``s t u p i d``).

Kernel. k(x, y) sums, over all subsequences of three letters (word ends count as letters) that span at most 8 places and
of five that span at most 7, the product of what x and y have of it: decay ** span for each occurrence. A letter put in
or a gap costs a factor, not the match. k is divided by functions of the lengths so that long words don't win by length.

Training. Labels say that a document is toxic, not where. Sentences of the sample inherit the label; a word
counts as often as it has different neighbours in them, so that copies of a document, exact or edited, don't make its
words look toxic. A subsequence tells toxic sentences from others by the lower confidence bound of its log odds, a word by
the sum over its subsequences: so that words of one stem vouch for each other, however few documents are labelled. Each
toxic document votes for its strongest words, which are the positives; words of other documents are the negatives, and
words that a first machine scores too high join them (hard negatives). The machine is linear over Nystroem features
k(., landmarks) K^(-1/2), fitted in the primal with squared hinge loss; the landmarks are words of both kinds. As a linear
machine over explicit features it folds into a table of weights by subsequence, so that scoring costs no kernel values.

Documents. Each unit, once for each different unit behind it, counts in a bin of margins; a bin is worth the log of how much
more often toxic documents have such units than others, and their sum is a document's evidence. Two parameters (Platt) make
a probability of it. Bins and curve are fitted on documents that the machine behind them was not fitted on (`FOLDS` parts
of the sample, each judged by a machine of the others); both labels weigh alike.

`sample` bounds the documents that are fitted on: about so many for each label, drawn by a hash of their id. `landmarks`
and `most_units` (positives, and negatives without the hard ones) bound the fit.

Defined results: null and empty texts have no evidence, and a score of at most 0.5. A document may have several labels; toxic wins. Labels
that are null, or whose document is absent, don't count. Without documents of both labels, or without a word that tells
them apart, every score is 0. Repeated documents are scored each for itself. Tables may be empty; other columns are
ignored. A text of any length is read whole, in parts.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import OWN, held, release
from vellumine.llm.words import _BYTE, _PLACE, NOT_SPACE, Words, is_long, long_text, mixed, pieces, plain, words

#: Of a place that a subsequence spans; places that a unit is followed by; places of a window of a long unit.
DECAY, SPAN, WIDE = 0.6, 8, 14
#: Word begin and end; 0 is no letter.
BEGIN, END = 62, 63
#: Subsequences: (letters, most places spanned, bits of the table of weights). Those of three letters have a cell each, longer ones are hashed.
ORDERS = ((3, 8, 18), (5, 7, 22))
#: Distances of the letters of a subsequence from its first, for each order.
STEPS = [[x for x in combinations(range(1, span), n - 1)] for n, span, _ in ORDERS]
#: Margins that bound the bins of a document's units.
EDGES = np.array([-0.5, -0.25, 0, 0.25, 0.5, 0.75, 1.0, 1.3])
BINS = len(EDGES) + 1
FOLDS = 5
#: Errors that a subsequence's log odds are lowered by, what a word's must reach, and its share of the document's strongest word.
ERRORS, LEAST, SHARE = 2.0, 2.0, 0.5
#: Letters of a piece of a long unit, in training.
PART = 64


def _letters() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    for i in range(26):
        out[65 + i] = out[97 + i] = i + 1
    # Signs that stand for letters: fixed values.
    for sign, letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
        out[ord(sign)] = ord(letter) - 96
    for i, digit in enumerate("2689"):
        out[ord(digit)] = 27 + i
    for b in range(0x80, 0xC0):  # the last byte of another script's letter stands for it
        out[b] = 31 + b % 31
    return out


_CODE = _letters()


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all units one after another, length of each unit, text of each unit)."""
    return _units(words(texts, NOT_SPACE))


def _units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(w):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    size = w.end - w.start
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    code = _CODE[w.data[np.repeat(w.start, size) + step]]
    kept = code > 0
    word_of = np.repeat(np.arange(len(size)), size)[kept]
    code = code[kept]
    n = np.bincount(word_of, minlength=len(size))
    text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    alone = np.flatnonzero(n == 1)
    some = n > 0
    begin = np.cumsum(n) - n
    more: list[np.ndarray] = []
    where: list[int] = []
    if len(alone) > 2:  # letters that stand alone in a row
        for run in np.split(alone, np.flatnonzero((np.diff(alone) != 1) | (np.diff(text_of[alone]) != 0)) + 1):
            if len(run) > 2:
                more.append(code[begin[run]])
                where.append(int(text_of[run[0]]))
    length, texts_ = n[some], text_of[some]
    if more:
        code = np.concatenate([code, *more])
        length = np.concatenate([length, [len(x) for x in more]])
        texts_ = np.concatenate([texts_, where])
    return code, length, texts_


def _framed(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units with their ends and SPAN places of no letter after each; where each begins."""
    room = length + 2 + SPAN
    begin = np.cumsum(room) - room
    out = np.zeros(int(room.sum()) + SPAN, dtype=np.int64)
    at = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(begin + 1, length) + at] = code
    out[begin], out[begin + length + 1] = BEGIN, END
    return out, begin


def _size(length: np.ndarray, order: int) -> np.ndarray:
    """What a unit of this length (ends included) is divided by: the root of its summed squared weights."""
    total = np.zeros(len(length))
    for steps in STEPS[order]:
        total += np.maximum(length - steps[-1], 0) * DECAY ** (2 * (steps[-1] + 1))
    return np.sqrt(np.maximum(total, DECAY ** (2 * ORDERS[order][0])))


def _cells(c: np.ndarray, m: int, order: int, steps: tuple[int, ...]) -> np.ndarray:
    """The cell of the table of weights for the subsequence that begins at each of the first m places; 0 where it has no letter somewhere."""
    letters = [c[:m], *[c[j : j + m] for j in steps]]
    there = letters[0] > 0
    code = letters[0]
    for x in letters[1:]:
        code = code << 6 | x
        there = there & (x > 0)
    bits = ORDERS[order][2]
    if 6 * len(letters) > bits:
        code = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    return np.where(there, code, 0)


def cells(code: np.ndarray, length: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, cell, weight) of every subsequence of the units: what the kernel multiplies."""
    c, begin = _framed(code, length)
    m, full = len(c) - SPAN, length + 2
    owner = np.full(m, -1)
    owner[np.repeat(begin, full) + np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)] = np.repeat(np.arange(len(length)), full)
    size = _size(full, order)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for steps in STEPS[order]:
        x = _cells(c, m, order, steps)
        at = np.flatnonzero((x > 0) & (owner >= 0))
        found.append((owner[at], x[at], DECAY ** (steps[-1] + 1) / size[owner[at]]))
    unit, cell, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    return unit, cell, weight


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Machine:
    """Weights by subsequence (for each order: cells, values), bias, what a unit of each bin is worth, and the two numbers that make a probability of a document's evidence."""

    weights: list[tuple[np.ndarray, np.ndarray]]
    bias: float
    worth: np.ndarray
    slope: float
    shift: float

    def margins(self, code: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of each unit; of a long one, the highest of its windows of WIDE places."""
        if not len(length):
            return np.zeros(0)
        c, begin = _framed(code, length)
        m = len(c) - SPAN
        full = length + 2
        long = np.flatnonzero(full > WIDE)
        n = full[long] - WIDE + 1
        at = np.repeat(begin[long], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out, window = np.zeros(len(length)), np.zeros(len(at))
        for order, table in enumerate(self._tables()):
            each = np.zeros(m + 1)
            for steps in STEPS[order]:
                each[1:] += table[_cells(c, m, order, steps)] * DECAY ** (steps[-1] + 1)
            run = np.cumsum(each)
            out += (run[begin + full] - run[begin]) / _size(full, order)
            window += (run[at + WIDE] - run[at]) / _size(np.array([WIDE]), order)[0]
        if len(long):
            out[long] = np.maximum.reduceat(window, np.cumsum(n) - n)
        return out + self.bias

    def _tables(self) -> list[np.ndarray]:
        if not hasattr(self, "_dense"):
            self._dense = []
            for (_, _, bits), (cells, values) in zip(ORDERS, self.weights, strict=True):
                table = np.zeros(1 << bits, dtype=np.float32)
                table[cells] = values
                self._dense.append(table)
        return self._dense

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    def probability(self, counted: np.ndarray) -> np.ndarray:
        """counted: for each document its units by bin."""
        return _logistic(self.slope * (counted @ self.worth) + self.shift)


class Scorer:
    """Counts the units of Arrow texts by their margins; keeps the margins of known units, in a table of bounded size."""

    def __init__(self, machine: Machine, known: int = 1_000_000):
        self.machine, self.known = machine, known
        self._clear()

    def _clear(self) -> None:
        from pandas._libs.hashtable import UInt64HashTable

        self.table, self.values, self.count = UInt64HashTable(1 << 16), np.zeros(1 << 16), 0

    def unit_margins(self, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margin, hash) of each unit."""
        from pandas._libs.hashtable import UInt64Vector

        if not len(length):
            return np.zeros(0), np.zeros(0, dtype=np.uint64)
        begin = np.cumsum(length) - length
        place = np.arange(len(code)) - np.repeat(begin, length)
        h = mixed(np.add.reduceat(_BYTE[code] * _PLACE[place & 4095], begin) + length.astype(np.uint64))
        if self.count + len(h) > self.known:
            self._clear()
        before = self.count
        label = self.table.get_labels(h, UInt64Vector(), before, -1).astype(np.int64)
        self.count = max(before, int(label.max()) + 1)
        if self.count > before:
            first = np.zeros(self.count - before, dtype=np.int64)
            fresh = np.flatnonzero(label >= before)[::-1]
            first[label[fresh] - before] = fresh
            n = length[first]
            at = np.repeat(begin[first], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            while len(self.values) < self.count:
                self.values = np.append(self.values, np.zeros_like(self.values))
            self.values[before : self.count] = self.machine.margins(code[at], n)
        return self.values[label], h

    def _keys(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash of a unit and the one behind it, bin) of each unit."""
        code, length, text_of = _units(w)
        margin, h = self.unit_margins(code, length)
        behind = np.zeros_like(h)
        same = text_of[1:] == text_of[:-1]
        behind[:-1][same] = h[1:][same]
        return text_of, mixed(h + behind * np.uint64(0x9E3779B97F4A7C15)), np.searchsorted(EDGES, margin, side="right")

    def counted(self, texts: pa.Array) -> np.ndarray:
        """For each text the number of its different pairs of neighbouring units in each bin, by the first one's margin."""
        out = np.zeros((len(texts), BINS))
        for lo, hi in pieces(texts):
            if is_long(texts, lo, hi):
                # Parts overlap, so that a row of letters that stand alone is seen whole; a pair counts once.
                every = [self._keys(w)[1:] for _, w in long_text(texts.slice(lo, 1), NOT_SPACE, PART)]
                key, bin_ = (np.concatenate(x) for x in zip(*every, strict=True))
                text_of = np.zeros(len(key), dtype=np.int64)
            else:
                text_of, key, bin_ = self._keys(words(texts.slice(lo, hi - lo), NOT_SPACE))
            if len(key):
                order = np.lexsort((key, text_of))
                first = order[np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(text_of[order]) != 0)))]
                np.add.at(out, (lo + text_of[first], bin_[first]), 1)
        return out


def _scorer(sent) -> Scorer:
    """This process's scorer of a broadcast machine: a worker keeps its table of known units from task to task."""
    machine = sent.value
    return held(("toxicity", machine.bias, machine.slope, machine.shift), lambda: Scorer(machine))


_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def _unit_texts(texts: list[str]) -> list[list[bytes]]:
    """Units of each text, as bytes of letter codes; long ones in overlapping pieces."""
    out: list[list[bytes]] = [[] for _ in texts]
    arr = pa.array(texts, pa.string())
    for lo, hi in pieces(arr):
        code, length, text_of = units(arr.slice(lo, hi - lo))
        raw, end = code.astype(np.uint8).tobytes(), np.cumsum(length)
        for a, b, t in zip((end - length).tolist(), end.tolist(), text_of.tolist(), strict=True):
            if b - a <= PART:
                out[lo + t].append(raw[a:b])
            else:
                out[lo + t] += [raw[i : min(i + PART, b)] for i in range(a, b, PART // 2)]
    return out


def _neighbours(sentences: list[str], vocabulary: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(words, counts): the number of different neighbours of a word, of the side that has fewer. Adds to the vocabulary."""
    sides: list[list[np.ndarray]] = [[], []]
    for lo in range(0, len(sentences), 5000):
        ids = []
        for u in _unit_texts(sentences[lo : lo + 5000]):
            ids.append(0)
            ids += [vocabulary.setdefault(x, len(vocabulary) + 1) for x in u]
        row = np.array([*ids, 0], dtype=np.int64)
        for side, other in zip(sides, (np.roll(row, 1), np.roll(row, -1)), strict=True):
            side.append(np.unique(row << 32 | other))
    least = None
    for side in sides:
        pair = np.unique(np.concatenate(side)) if side else np.zeros(0, dtype=np.int64)
        n = np.bincount(pair >> 32, minlength=len(vocabulary) + 1)
        least = n if least is None else np.minimum(least, n)
    single = np.fromiter((len(x) > 1 for x in vocabulary), dtype=bool, count=len(vocabulary))
    at = np.flatnonzero((least[1:] > 0) & single)
    return at.tolist(), least[1:][at].tolist()


def _flat(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), dtype=np.uint8).astype(np.int64), np.array([len(x) for x in found], dtype=np.int64)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps; the last column of x is constant."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(50):
        on = y * (x @ w) < 1
        a = x[on] * cost[on, None]
        step = np.linalg.solve(a.T @ x[on] + np.diag(reg), a.T @ y[on])
        if np.abs(step - w).max() < 1e-7:
            break
        w = step
    return w


def _chunks(found: list[bytes], n: int) -> Iterator[tuple[int, list[bytes]]]:
    for lo in range(0, len(found), n):
        yield lo, found[lo : lo + n]


def strengths(pos: dict[bytes, int], neg: dict[bytes, int]) -> dict[bytes, float]:
    """For each word of pos: the weighted sum, over its subsequences, of the lower bound of how much more often (log odds) words of pos have them."""
    out = np.zeros(len(pos))
    every = [max(1, sum(x.values())) for x in (pos, neg)]
    for order, (_, _, bits) in enumerate(ORDERS):
        n = 1 << bits
        seen = []
        for counts in (pos, neg):
            table = np.zeros(n)
            for _, part in _chunks(list(counts), 4000):
                unit, cell, _ = cells(*_flat(part), order)
                key = np.sort(unit * n + cell)
                key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
                table += np.bincount(key % n, weights=np.array([counts[u] for u in part], dtype=float)[key // n], minlength=n)
            seen.append(table + 0.5)
        bound = np.log(seen[0] / every[0]) - np.log(seen[1] / every[1]) - ERRORS * np.sqrt(1 / seen[0] + 1 / seen[1])
        bound = np.clip(bound, 0, 4)
        for lo, part in _chunks(list(pos), 4000):
            unit, cell, weight = cells(*_flat(part), order)
            out[lo : lo + len(part)] += np.bincount(unit, weights=weight * bound[cell], minlength=len(part))
    return dict(zip(pos, out.tolist(), strict=True))


class Landmarks:
    """Kernel values with some words, through the subsequences that these have."""

    def __init__(self, marks: list[bytes]):
        self.n = len(marks)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for order in range(len(ORDERS)):
            unit, cell, weight = cells(*_flat(marks), order)
            known, at = np.unique(cell, return_inverse=True)
            table = np.zeros((len(known), self.n))
            np.add.at(table, (at, unit), weight)
            self.tables.append((known, table))

    def kernel(self, found: list[bytes]) -> np.ndarray:
        out = np.zeros((len(found), self.n))
        for order, (known, table) in enumerate(self.tables):
            for lo, part in _chunks(found, 100):
                unit, cell, weight = cells(*_flat(part), order)
                at = np.minimum(np.searchsorted(known, cell), len(known) - 1)
                have = known[at] == cell
                dense = np.bincount(unit[have] * len(known) + at[have], weights=weight[have], minlength=len(part) * len(known))
                out[lo : lo + len(part)] += dense.reshape(len(part), len(known)) @ table
        return out


def separate(toxic: list[str], clean: list[str], landmarks: int, most_units: int, seed: int) -> Machine | None:
    """The machine of units, without worths and probabilities; None where no word tells the labels apart."""
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    counts = []
    for texts in (toxic, clean):
        sentences = list(dict.fromkeys(s for t in texts for s in _SENTENCE.split(t) if s))
        counts.append(_neighbours(sentences, vocabulary))
    names = list(vocabulary)
    pos, neg = ({names[i]: n for i, n in zip(*x, strict=True)} for x in counts)
    strength = strengths(pos, neg) if pos and neg else {}
    # Each toxic document vouches for its strongest words only: what explains it already leaves nothing for the rest.
    votes: Counter = Counter()
    for have in map(set, _unit_texts(toxic)):
        mine = sorted((u for u in have if strength.get(u, 0.0) > LEAST), key=lambda u: (-strength[u], u))
        votes.update(u for u in mine if strength[u] >= SHARE * strength[mine[0]])
    positive = sorted(votes, key=lambda u: (-votes[u], u))[:most_units]
    if not positive:
        return None
    chosen = set(positive)
    pool = sorted((u for u in neg if u not in chosen), key=lambda u: (-neg[u], u))
    rest = pool[most_units // 3 :]
    negative = pool[: most_units // 3] + [rest[i] for i in rng.permutation(len(rest))[: 2 * most_units // 3]]
    if not negative:
        return None
    marks = [positive[i] for i in rng.permutation(len(positive))[: landmarks // 2]]
    marks += [negative[i] for i in rng.permutation(len(negative))[: landmarks - len(marks)]]
    land = Landmarks(marks)
    value, vector = np.linalg.eigh(land.kernel(marks))
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # K^(-1/2), in its eigenvectors
    voted = np.sqrt(np.array([votes[u] for u in positive], dtype=float))

    def trained(plus: np.ndarray, minus: np.ndarray) -> Machine:
        x = np.concatenate([plus, minus]) @ root
        x = np.column_stack([x, np.ones(len(x))])
        y = np.array([1.0] * len(plus) + [-1.0] * len(minus))
        cost = 0.5 * len(y) * np.concatenate([voted / voted.sum(), np.full(len(minus), 1 / len(minus))])
        w = _svm(x, y, cost)
        return Machine([(known, table @ (root @ w[:-1])) for known, table in land.tables], float(w[-1]), np.zeros(BINS), 1.0, 0.0)

    plus, minus = land.kernel(positive), land.kernel(negative)
    machine = trained(plus, minus)
    every = list(neg)  # also positives that other documents have
    have = set(negative)
    for _ in range(5):
        got = np.concatenate([machine.margins(*_flat(part)) for _, part in _chunks(every, 20_000)])
        hard = [every[i] for i in np.argsort(-got, kind="stable")[: most_units // 2].tolist() if got[i] > -0.5 and every[i] not in have]
        if not hard:
            break
        negative += hard
        have.update(hard)
        minus = np.concatenate([minus, land.kernel(hard)])
        machine = trained(plus, minus)
    return machine


def fitted(toxic: list[str], clean: list[str], fold: int, landmarks: int, most_units: int, seed: int) -> tuple[Machine | None, np.ndarray, np.ndarray]:
    """A machine of the documents outside of a part of the sample, and the counts by bin of the documents in it (toxic, clean). fold FOLDS: the machine of
    all, and theirs."""
    part = lambda texts, inside: [t for t in texts if fold == FOLDS or (zlib.crc32(t.encode()) % FOLDS == fold) == inside]
    machine = separate(part(toxic, False), part(clean, False), landmarks, most_units, seed)
    if machine is None:
        return None, np.zeros((0, BINS)), np.zeros((0, BINS))
    scorer = Scorer(machine)
    return machine, *(scorer.counted(pa.array(part(x, True), pa.string())) for x in (toxic, clean))


def combined(parts: dict[int, tuple[Machine | None, np.ndarray, np.ndarray]]) -> Machine | None:
    """The machine of the whole sample, with the worths and the curve that the parts give (its own counts, where no part has a machine)."""
    machine = parts[FOLDS][0]
    if machine is None:
        return None
    told = [p for k, p in parts.items() if k < FOLDS and p[0] is not None]
    toxic, clean = (np.concatenate([p[i] for p in told]) if told else np.zeros((0, BINS)) for i in (1, 2))
    if not len(toxic) or not len(clean):
        toxic, clean = parts[FOLDS][1:]
    a, b = toxic.sum(0), clean.sum(0)
    machine.worth = np.maximum.accumulate(np.log((a + 0.5) / (a.sum() + 1)) - np.log((b + 0.5) / (b.sum() + 1)))  # a higher margin is worth no less
    machine.slope, machine.shift = _platt(np.concatenate([toxic, clean]) @ machine.worth, np.repeat([1.0, 0.0], [len(toxic), len(clean)]))
    return machine


def fit(toxic: list[str], clean: list[str], landmarks: int = 240, most_units: int = 3000, seed: int = 5) -> Machine | None:
    """A machine from texts of both labels, or None without both."""
    return combined({k: fitted(toxic, clean, k, landmarks, most_units, seed) for k in range(FOLDS + 1)})


def _platt(evidence: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with Platt's targets and equal weight of both labels; no evidence is never toxic."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    x = np.column_stack([evidence, np.ones(len(evidence))])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(weight * (np.logaddexp(0, z) - target * z)) + 5e-5 * w @ w)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = _logistic(x @ w)
        grad = x.T @ (weight * (p - target)) + 1e-4 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(w[0], 0.1)), float(min(w[1], 0.0))


def is_held_out(id_: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 1200, landmarks: int = 240, most_units: int = 3000, seed: int = 5, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine | None:
    """Fits on about `sample` documents of each label, none of them held out, and on 4 x `sample` at most. The machines of the whole sample and of its parts
    are a task each on executors, over that bounded sample; the driver sees machines and counts alone."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter(~is_held_out(F.col("id")) & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    # A share of each label's documents by the hash of their id: about `sample` of them, however many there are.
    ids = docs.select(F.col(id_col).alias("id")).distinct().join(told, "id")
    share = {r.label: min(1.0, sample / r.n) for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(2**53)
    drawn = ids.filter(F.coalesce(*[F.when(F.col("label") == k, place < x) for k, x in share.items()], F.lit(False)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    some = texts.join(F.broadcast(drawn), "id")  # about 2 x sample ids
    some = some.orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(4 * sample)  # also where an id is repeated many times

    def run(key: tuple, group: pa.Table) -> pa.Table:
        release()
        rows = sorted((r["id"], r["text"], r["label"]) for r in group.select(["id", "text", "label"]).to_pylist())
        by_label = [[t for _, t, k in rows if k == label_] for label_ in (1, 0)]
        found = fitted(*by_label, key[0].as_py(), landmarks, most_units, seed)
        return pa.table({"fold": [key[0].as_py()], "found": [pickle.dumps(found)]}, schema=pa.schema([("fold", pa.int32()), ("found", pa.binary())]))

    dealt = some.select("id", "text", "label", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))).alias("fold")).repartitionByRange(FOLDS + 1, "fold")
    parts = {r.fold: pickle.loads(bytes(r.found)) for r in dealt.groupBy("fold").applyInArrow(run, "fold int, found binary").collect()}
    return combined(parts) if FOLDS in parts else None


def score(docs: DataFrame, machine: Machine | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "score") -> DataFrame:
    """keep..., out (0 to 1) for each document."""
    own = text if text in keep else OWN + "text"
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).cast("string").alias(own))
    if machine is None:
        return rows.select(*keep, F.lit(0.0).alias(out))
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # some thousand weights, whatever the input
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep], f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent)
        for batch in batches:
            p = sent.value.probability(scorer.counted(plain(batch.column(own))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(p)], names=[*keep, out])

    return rows.mapInArrow(run, schema)
