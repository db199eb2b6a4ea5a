"""Phrases whose words occur together more often than apart: Rabin-Karp fingerprints of word sequences.

Texts are lower-cased (A-Z) and cut at `[.,;:!?\\x0A-\\x0D]` into pieces, and those at spaces and tabs into words. With the
prefix polynomials P[i] = h[0] + h[1] B + ... + h[i-1] B^(i-1) of the words' hashes, (P[i+k] - P[i]) / B^i modulo 2^64 is
the fingerprint of the k words from i on, wherever they stand: three numpy operations for all places. A language's hash is
added, as all counts are by language.

1. Counting, for k = 1, 2, ... `longest`: each task counts the fingerprints of a slice, and a shuffle sums them up. A sequence can only
   be frequent if its first and its last k - 1 words are, so from k = 2 on only such places are counted. What is frequent is a
   table; tasks know it by a table of 2 ** `bits` bits, whatever its size. What the bits let through by chance only costs a count.
2. Materialising: one more pass looks at the places of frequent fingerprints. A slice has a pointer to the first occurrence of
   each; the words there are compared with those of all its other occurrences in the slice, byte by byte, and read out. Text, count and
   pointer (the id of its document) are then summed up by the text itself. So equal fingerprints of different phrases are told apart, and
   a phrase's count is exact: no result depends on a hash. Rare phrases are never written out.
3. Scoring: a cut after the first k words needs the counts of both parts, which are frequent too. The joins deal a part that
   very many phrases share. Arithmetic is in decimals of 38 digits.

Defined results: a null or empty text has no words; null language is `und`. Repeated rows count as often as they stand there. Ties
in score and count go by phrase. Languages without candidates, and empty tables, give no rows. Other columns are ignored. A long text is read in parts
that share longest - 1 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import bit_table, dealt_join, release, written
from vellumine.llm.words import PIECE, Words, is_long, long_text, mixed, pieces, plain, words

_CUTS = np.zeros(256, dtype=bool)
_CUTS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_CUTS
_INSIDE[[*b" \t"]] = False

_BASE = 0xC2B2AE3D27D4EB4F | 1
_BACK = pow(_BASE, -1, 1 << 64)
#: Fingerprints that a task counts at once.
SLICE = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Sequences:
    """Fingerprints of the word sequences of some texts. new: the first words that were counted with an earlier part."""

    def __init__(self, w: Words, salts: np.ndarray, fp_bits: int, seen: int = 0):
        self.w, self.seen, self.mask = w, seen, np.uint64((1 << fp_bits) - 1 << 64 - fp_bits)
        n = len(w)
        text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        cut = np.cumsum(_CUTS[w.data])
        cut = cut[w.start] if n else cut[:0]
        self.joined = (cut[1:] == cut[:-1]) & (text_of[1:] == text_of[:-1])  # does the next word go on?
        self.salt = salts[text_of]
        self.prefix = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(w.hashes() * _powers(_BASE, n), dtype=np.uint64)))
        self.back = _powers(_BACK, n)

    def places(self, k: int) -> np.ndarray:
        """Where k words of one piece begin."""
        n = len(self.w) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        ok = np.ones(n, dtype=bool)
        for j in range(k - 1):
            ok &= self.joined[j : j + n]
        ok[: max(0, self.seen - k + 1)] = False
        return np.flatnonzero(ok)

    def prints(self, at: np.ndarray, k: int) -> np.ndarray:
        h = (self.prefix[at + k] - self.prefix[at]) * self.back[at]
        return mixed(h + self.salt[at] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) & self.mask


def _known(table: np.ndarray, bits: int, prints: np.ndarray) -> np.ndarray:
    place = (prints >> np.uint64(64 - bits)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _salts(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for each text's language, and the languages."""
    import xxhash

    told = langs.fill_null("und").to_pylist()
    of = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(told)}
    return np.array([of[x] for x in told], dtype=np.uint64), told


def _parts(batch: pa.RecordBatch, longest: int, fp_bits: int, size: int = PIECE) -> Iterator[tuple[int, int, int, Sequences, list[str]]]:
    """(first row, last row + 1, words before, sequences, languages) of ranges of rows; a long text comes in parts."""
    texts = plain(batch.column("text"))
    salts, langs = _salts(batch.column("lang"))
    for lo, hi in pieces(texts, size):
        if is_long(texts, lo, hi):
            upto = 0
            for before, w in long_text(texts.slice(lo, 1), _INSIDE, longest - 1):
                yield lo, hi, before, Sequences(w, salts[lo:hi], fp_bits, upto - before), langs[lo:hi]
                upto = before + len(w)
        else:
            yield lo, hi, 0, Sequences(words(texts.slice(lo, hi - lo), _INSIDE), salts[lo:hi], fp_bits), langs[lo:hi]


def _counts(rows: DataFrame, k: int, longest: int, fp_bits: int, known, bits: int) -> DataFrame:
    """fp, n: how often the fingerprints of k words occur. known: bits of the frequent ones of k - 1 words (a broadcast value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0

        def out() -> pa.RecordBatch:
            fp, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n)], names=["fp", "n"])

        for batch in batches:
            for _, _, _, s, _ in _parts(batch, longest, fp_bits):
                at = s.places(k)
                if k > 1:
                    at = at[_known(known.value, bits, s.prints(at, k - 1))]
                    at = at[_known(known.value, bits, s.prints(at + 1, k - 1))]
                held.append(s.prints(at, k))
                size += len(at)
                if size > SLICE:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return rows.select("text", "lang").mapInArrow(run, "fp bigint, n bigint").groupBy("fp").agg(F.sum("n").alias("n"))


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges one after another, and where each begins."""
    begin = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(start - begin, size)], begin


def _spaced(s: Sequences, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, size) of the phrases of k words at some places, words joined by one space."""
    w = s.w
    size = np.stack([w.end[at + j] - w.start[at + j] + (j < k - 1) for j in range(k)], axis=1).ravel()
    start = np.stack([w.start[at + j] for j in range(k)], axis=1).ravel()
    out, begin = _gathered(w.data, start, size)
    out[(begin + size - 1).reshape(-1, k)[:, :-1].ravel()] = 32  # the byte behind each word but the last
    whole = size.reshape(-1, k).sum(axis=1)
    return out, np.cumsum(whole) - whole, whole


def _grouped(s: Sequences, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence, count) of each phrase among some places: by fingerprint, if all occurrences have the words of the first one; else by words."""
    prints = s.prints(at, k)
    _, first, of, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    body, begin, size = _spaced(s, at, k)
    mine = first[of]
    same = (size == size[mine]) & (s.salt[at] == s.salt[at[mine]])
    check = np.flatnonzero(same & (mine != np.arange(len(at))))
    a, start = _gathered(body, begin[check], size[check])
    b, _ = _gathered(body, begin[mine[check]], size[check])
    wrong = np.concatenate(([0], np.cumsum(a != b)))
    same[check] = wrong[start + size[check]] == wrong[start]
    if same.all():
        return at[first], n
    raw = body.tobytes()
    seen: dict[tuple[int, bytes], list[int]] = {}
    for i, (b0, m, salt) in enumerate(zip(begin.tolist(), size.tolist(), s.salt[at].tolist(), strict=True)):
        seen.setdefault((salt, raw[b0 : b0 + m]), []).append(i)
    return at[[x[0] for x in seen.values()]], np.array([len(x) for x in seen.values()])


_FOUND = "lang string, k int, phrase string, n bigint, example bigint"


def _row_of(s: Sequences, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(s.w.first, at, side="right") - 1


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = 27, fp_bits: int = 64, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, k, phrase, n, example (a document that has it) of each sequence of k <= longest words that occurs `least` times; where k is 0, n is the language's number of words."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    tables = []
    for k in range(1, longest + 1):
        counted = _counts(rows, k, longest, fp_bits, tables[-1] if tables else None, bits)
        often = written(counted.filter(F.col("n") >= least).select("fp"), "phrases-frequent")
        tables.append(docs.sparkSession.sparkContext.broadcast(bit_table(often, ["fp"], bits)))  # 2 ** bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, _, s, langs in _parts(batch, longest, fp_bits, 2 * PIECE):
                told = dict.fromkeys(langs, 0)
                for x, n in zip(langs, np.bincount(_row_of(s, s.places(1)), minlength=hi - lo).tolist(), strict=True):
                    told[x] += n
                m = len(told)
                yield pa.RecordBatch.from_arrays([pa.array([*told], pa.string()), pa.array([0] * m, pa.int32()), pa.array([""] * m), pa.array([*told.values()], pa.int64()), pa.nulls(m, pa.int64())], names=["lang", "k", "phrase", "n", "example"])
                names, mine = pa.array(langs, pa.string()), ids.slice(lo, hi - lo)
                for k, table in enumerate(tables, 1):
                    at = s.places(k)
                    at = at[_known(table.value, bits, s.prints(at, k))]
                    if not len(at):
                        continue
                    at, n = _grouped(s, at, k)
                    body, begin, size = _spaced(s, at, k)
                    ends = np.append(begin, begin[-1] + size[-1]).astype(np.int32)
                    phrase, row = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(body)]), pa.array(_row_of(s, at))
                    yield pa.RecordBatch.from_arrays([names.take(row), pa.array(np.full(len(at), k, dtype=np.int32)), phrase, pa.array(n), mine.take(row)], names=["lang", "k", "phrase", "n", "example"])

    summed = rows.mapInArrow(run, _FOUND).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"), F.min("example").alias("example"))
    return summed.filter((F.col("k") == 0) | (F.col("n") >= least))


def _joined(of: Column, lo: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(of, F.lit(lo) if isinstance(lo, int) else lo, F.lit(n) if isinstance(n, int) else n), " ")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, scale: int = 1_000_000, top: int = 2000, bits: int = 27, fp_bits: int = 64,
                 id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, cut, l, r, n, score, example: each language's `top` phrases. A phrase goes if one that holds it occurs at least `share` percent as often."""
    return scored(written(frequent_phrases(docs, longest, least, bits, fp_bits, id_col, text, lang), "phrases-found"), share, scale, top)


def scored(found: DataFrame, share: int = 50, scale: int = 1_000_000, top: int = 2000) -> DataFrame:
    """The same of a table that `frequent_phrases` made."""
    phrases = found.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), "example", F.split("phrase", " ").alias("words"))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _joined(F.col("words"), i, m))))
    inside = phrases.filter("k > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")
    each = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = each.select("lang", "phrase", "a", "example", "cut", _joined(F.col("words"), 1, F.col("cut")).alias("left"), _joined(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    counts = found.filter("k >= 1").select("lang", "phrase", "n")
    sides = written(sides, "phrases-cuts")
    for side, name in (("left", "l"), ("right", "r")):
        sides = written(dealt_join(sides, counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side], "phrase"), "phrases-cuts")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    rated = sides.withColumn("up", F.lit(scale).cast("decimal(38,0)") * exact("a") * exact("a")).withColumn("down", exact("l") * exact("r")).withColumn("score", F.expr("up div down"))
    lowest = rated.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "example")).alias("best")).select("lang", "phrase", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order))).filter(F.col("rank") <= top)
    # The best of each of 256 parts of a language first, so that none is sorted in one task.
    best = ranked(ranked(lowest.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(256))), "deal").drop("deal", "rank"))
    words_ = found.filter("k = 0").select("lang", "n")
    return best.join(words_, "lang").select("lang", "rank", "phrase", "a", "cut", "l", "r", "n", "score", "example")
