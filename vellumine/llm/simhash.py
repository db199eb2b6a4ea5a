"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Two fingerprints are linked if
they differ in at most 4 of 64 bits; groups are the connected components.

Keys. The 64 bits are cut into segments of 23, 23 and 18 bits (the last padded with zeros). The binary Golay code
[23,12,7] is perfect: each 23-bit word has exactly one codeword within 3 bits. Of 4 errors over three segments, the two
segments that have fewest get (0, 0), (0, 1), (0, 2) or (1, 1):

* (0, up to 2): the first segment is a part of the key as it is; words 2 bits apart share a codeword within 4 bits of
  both (that of the word between them), so each of the 1 to 6 codewords within 4 bits gives a key.
* (1, 1): if y is 1 bit from x, the codeword that y decodes to is within 4 bits of x. So one key of the two decoded
  codewords is stored, and every pair of codewords within 4 bits is looked up.

So every pair of fingerprints that is to be linked meets under one of these keys at least (35 or 24 bits and a kind),
and everything that meets is verified by counting differing bits.

Copies have one fingerprint, and only distinct fingerprints are keyed. A key's fingerprints aren't expanded into
pairs: a worker grows the linked groups among them and returns one row for each fingerprint, its group's least. A key
with more than `block` fingerprints is dealt out as pairs of blocks, which together see every pair once, so that no task
holds an unbounded key. Components come from alternating star contraction over those rows, cut by written tables.

The joins of fingerprints and of copies with their component are dealt in `SALTS` parts a key, as one group or one
fingerprint may hold a third of all rows.

Defined results: null and empty texts have fingerprint zero and are linked like any other. Rows with equal ids are
rows of their own; ids are whole numbers (a text that is none is an error). component_id is the least id that is not null, null if there is none. Other columns are ignored. An
empty table gives no rows. A text of any length is read whole, in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import dealt_join, release, written
from vellumine.llm.words import NOT_SPACE, Words, is_long, long_text, pieces, plain, words

SHINGLE, SEED, FAR = 4, 42, 4
#: Widths of the segments, lowest bits first.
SEGMENTS = (23, 23, 18)
#: Of the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code.
GENERATOR = 0b101011100011


def _bit_sums(w: Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many hashes of its shingles have each of the 64 bits; and how many shingles it has."""
    n = np.diff(w.first)
    sums = np.zeros((len(n), 64), dtype=np.int64)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    if not len(w):
        return sums, count
    # The words again, with one space after each: a shingle is then one slice.
    size = w.end - w.start
    at = np.cumsum(size + 1) - size - 1
    joined = np.full(int(at[-1] + size[-1] + 1), 32, dtype=np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(at, size) + step] = w.data[np.repeat(w.start, size) + step]
    raw = joined.tobytes()
    text_of = np.repeat(np.arange(len(n)), count)
    first = np.repeat(w.first[:-1], count) + np.arange(len(text_of)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(first + shingle, w.first[text_of + 1]) - 1
    hash_ = xxhash.xxh64_intdigest
    h = np.fromiter((hash_(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + size[last]).tolist(), strict=True)), dtype=np.uint64, count=len(first))
    starts = np.cumsum(count) - count
    full = np.flatnonzero(count)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums[full] = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
    return sums, count


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint for each text. A single long text is read in parts that share shingle - 1 words."""
    if is_long(texts, 0, len(texts)):
        sums, count = np.zeros((1, 64), dtype=np.int64), np.zeros(1, dtype=np.int64)
        for before, w in long_text(texts, NOT_SPACE, shingle - 1):
            if len(w) >= shingle or not before:
                part, n = _bit_sums(w, shingle)
                sums, count = sums + part, count + n
    else:
        sums, count = _bit_sums(words(texts, NOT_SPACE), shingle)
    return np.packbits(sums * 2 > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the syndrome of a 23-bit word: the error pattern of weight 3 at most, and the patterns of weight 4 (5 or none). Also the syndromes of single bits."""
    single = []
    for b in range(23):
        r = 1 << b
        for d in range(22, 10, -1):
            if r >> d & 1:
                r ^= GENERATOR << (d - 11)
        single.append(r)
    near = np.full(2048, -1, dtype=np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]

    def patterns(k: int, lo: int = 0, word: int = 0, s: int = 0) -> Iterator[tuple[int, int]]:
        if not k:
            yield word, s
            return
        for b in range(lo, 23):
            yield from patterns(k - 1, b + 1, word | 1 << b, s ^ single[b])

    for k in range(4):
        for word, s in patterns(k):
            near[s] = word
    for word, s in patterns(4):
        far[s].append(word)
    assert (near >= 0).all()
    # Only words 3 bits from the code have others at 4 bits: five of them.
    table = np.full((2048, 6), -1, dtype=np.int64)
    table[:, 0] = near
    for s, x in enumerate(far):
        assert len(x) in (0, 5)
        table[s, 1 : 1 + len(x)] = x
    # Syndromes of words by halves.
    low = np.zeros(4096, dtype=np.int64)
    high = np.zeros(2048, dtype=np.int64)
    for b in range(23):
        half, place = (low, b) if b < 12 else (high, b - 12)
        half[(np.arange(len(half)) >> place & 1) == 1] ^= single[b]
    return table, low, high


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: indices (12 bits) of the codewords within 4 bits, the nearest first, in 6 columns; and which of those there are."""
    table, low, high = _golay()
    errors = table[low[x & 4095] ^ high[x >> 12]]
    return (x[:, None] ^ np.maximum(errors, 0)) >> 11, errors >= 0  # systematic: the upper 12 bits tell the codeword


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for n in SEGMENTS:
        out.append((fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64))
        at += n
    return out


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the fingerprint, key, role): role 1 is stored, 2 looked up, 3 both."""
    seg = _segments(fp)
    words_ = [codewords(s) for s in seg]
    rows = np.arange(len(fp))
    place, key, role = [], [], []

    def add(r: np.ndarray, k: np.ndarray, kind: int, what: int) -> None:
        place.append(r)
        key.append(k | kind << 48)
        role.append(np.full(len(r), what, dtype=np.int8))

    kind = 0
    for a, b in ((0, 1), (0, 2), (1, 2)):
        for exact, near in ((a, b), (b, a)):
            code, there = words_[near]
            r, c = np.nonzero(there)
            add(rows[r], seg[exact][r] << 12 | code[r, c], kind, 3)
            kind += 1
        (ca, ta), (cb, tb) = words_[a], words_[b]
        r, i, j = np.nonzero(ta[:, :, None] & tb[:, None, :])
        own = (i == 0) & (j == 0)
        add(rows[r], ca[r, i] << 12 | cb[r, j], kind, 2)
        role[-1][own] = 3
        kind += 1
    return np.concatenate(place), np.concatenate(key), np.concatenate(role)


#: Runs of up to so many fingerprints are compared with each other at once, array against array.
SMALL = 8


def _grown(fp: np.ndarray, far: int, direct: bool = False) -> np.ndarray:
    """For each fingerprint the least of its linked group; direct: instead the one from which it was reached, so one within `far` bits."""
    root = np.full(len(fp), -1, dtype=np.int64)
    order = np.argsort(fp, kind="stable")
    for first in order.tolist():
        if root[first] >= 0:
            continue
        root[first] = first
        todo = [first]
        while todo:
            free = np.flatnonzero(root < 0)
            if not len(free):
                break
            now = todo.pop()
            near = free[np.bitwise_count(fp[free] ^ fp[now]) <= far]
            root[near] = now if direct else first
            todo += near.tolist()
    return fp[root]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_FOUND = "a bigint, b bigint, key bigint, chunk int"


def _found(a: np.ndarray, b: np.ndarray, key: int | None = None, chunk: int = 0) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array([key] * n, pa.int64()), pa.array([chunk] * n, pa.int32())], names=["a", "b", "key", "chunk"])


def _linked_runs(fp: np.ndarray, key: np.ndarray, role: np.ndarray, far: int, direct: bool = False) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal keys; whole runs only."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    length = np.repeat(size, size)
    a, b = [], []
    for d in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((key[:-d] == key[d:]) & (length[:-d] <= SMALL) & ((role[:-d] | role[d:]) == 3))
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= far]
        a.append(fp[i])
        b.append(fp[i + d])
    for r in np.flatnonzero(size > SMALL).tolist():
        run = fp[edge[r] : edge[r + 1]]
        if (role[edge[r] : edge[r + 1]] & 1).any():
            run = np.unique(run)
            low = _grown(run, far, direct)
            a.append(run[low != run])
            b.append(low[low != run])
    a_, b_ = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (a, b))
    both = a_ != b_
    if both.any():
        yield _found(np.maximum(a_, b_)[both], np.minimum(a_, b_)[both])


def linked(prints: DataFrame, far: int = FAR, block: int = 4096, direct: bool = False) -> DataFrame:
    """a, b: links that connect the same groups as all links do. prints: fp (bigint), distinct. direct: only links of at most `far` bits."""
    if far > FAR:
        raise ValueError(f"the keys find what differs in at most {FAR} bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), 2000):
                fp = every[lo : lo + 2000]
                place, key, role = keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), _signed(fp[place]), pa.array(role)], names=["key", "fp", "role"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8))
        hot, chunk = None, 0

        def split(key: int, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            for lo in range(0, len(fp), block):
                part = fp[lo : lo + block]
                yield _found(part, part, key, chunk)
                chunk += 1

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "role")]
            new[1] = new[1].view(np.uint64)
            key, fp, role = (np.concatenate(x) for x in zip(held, new, strict=True))
            if hot is not None:
                n = int(np.searchsorted(key, hot, side="right"))
                yield from split(hot, fp[:n])
                if n == len(key):
                    held = (key[n:], fp[n:], role[n:])
                    continue
                key, fp, role, hot, chunk = key[n:], fp[n:], role[n:], None, 0
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            yield from _linked_small(key[:last], fp[:last], role[:last])
            held = (key[last:], fp[last:], role[last:])
            if len(held[0]) > block:
                hot = int(held[0][0])
                yield from split(hot, held[1])
                held = tuple(x[:0] for x in held)
        if len(held[0]):
            yield from _linked_small(*held)

    def _linked_small(key: np.ndarray, fp: np.ndarray, role: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        for r in np.flatnonzero(size > block).tolist():
            for c, lo in enumerate(range(int(edge[r]), int(edge[r + 1]), block)):
                part = fp[lo : min(lo + block, int(edge[r + 1]))]
                yield _found(part, part, int(key[edge[r]]), c)
        keep = np.repeat(size <= block, size)
        if keep.any():
            yield from _linked_runs(fp[keep], key[keep], role[keep], far, direct)

    keyed = prints.mapInArrow(emit, "key bigint, fp bigint, role tinyint").repartition("key").sortWithinPartitions("key")
    found = written(keyed.mapInArrow(meet, _FOUND).distinct(), "simhash-links")  # a link is found under several keys
    links = found.filter("key IS NULL").select("a", "b")
    large = found.filter("key IS NOT NULL")
    if not large.isEmpty():
        links = links.unionByName(_large_keys(large, far, direct))
    return links.distinct()


def _large_keys(rows: DataFrame, far: int, direct: bool = False) -> DataFrame:
    """Links under keys of many fingerprints: each pair of blocks is a group of its own, of two blocks at most."""
    chunks = rows.groupBy("key").agg(F.max("chunk").alias("n"))
    every = F.sequence(F.lit(0), F.col("n"))
    dealt = rows.join(chunks, "key").select("key", F.col("a").alias("fp"), F.explode(F.transform(every, lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))).alias("pair"))

    def grow(_: tuple, group: pa.Table) -> pa.Table:
        fp = np.unique(group.column("fp").to_numpy().view(np.uint64))
        low = _grown(fp, far, direct)
        return pa.Table.from_arrays([_signed(fp[low != fp]), _signed(low[low != fp])], names=["a", "b"])

    return dealt.groupBy("key", "pair").applyInArrow(grow, "a bigint, b bigint")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root for every node of the links (columns a, b) but the roots: root is the least node that can be reached. Alternating large and small stars."""
    state = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "simhash-stars")
    told = None
    for _ in range(most_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        state = written(small.filter("u <> v").distinct(), "simhash-stars")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == told:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        told = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, far: int = FAR, shingle: int = SHINGLE, block: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (bigint), component_id for each document."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = plain(batch.column("text"))
            for lo, hi in pieces(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), _signed(fingerprints(texts.slice(lo, hi - lo), shingle))], names=["doc_id", "fp"])

    marked = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(mark, "doc_id bigint, fp bigint"), "simhash-prints")
    prints = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(linked(prints.select("fp"), far, block))
    grouped = written(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-groups")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return dealt_join(marked, dealt_join(grouped, named, ["root"], "fp").select("fp", "component_id"), ["fp"], "doc_id").select("doc_id", "fp", "component_id")
