"""Packing documents into sequences by lexical retrieval: a sharded BM25 inverted index finds what goes on in a document's window.

1. `tokenised` encodes each text once and cuts it into windows of `length` ids. A full window is a sequence of its own; what is left
   behind the last one (less than a window) is the document's rest.
2. Rests are sorted by two least hashes of their documents' words, so that documents of like words are near each other, and
   dealt by ranges; a shard is `shard` neighbours of that order. Any order gives right results; it only decides what is found.
3. Each shard has an inverted index with BM25 weights, from its own counts. The first unused rest is a seed. Its `terms` most telling
   words are the query; unused neighbours go into its window by score, as long as they fit whole. The best of those that didn't fit
   is cut to fill the window, and what remains of it stays unused. Where no neighbour shares a word, the next rests of the order do.
4. What a shard has left at its end is the first of the next one; at a partition's end a window that isn't full is cut into sequences of
   powers of two. So no sequence is padded at all.

Words are read off the ids: an id that begins with a space begins one, ids without letters or digits end it, the same in any case.
They serve retrieval only.

A task holds a shard (at most `shard` * `length` ids) and its index; only rests are shuffled, once, with their ids, and pieces leave
complete. Groups of copies spread over shards by row.

Defined results: a null text is empty: with the end id alone. Repeated rows, ids and null ids are documents of their own. Ties in
score go by the shard's order. An empty table gives no pieces. Other columns are ignored. A document's windows leave one by one; a very long
text is encoded as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import held, written
from vellumine.llm.encoder import Encoder, encoder
from vellumine.llm.words import mixed, pieces, plain

LENGTH, SHARD, TERMS = 1024, 2048, 16
#: The usual constants of BM25.
K1, B = 1.2, 0.75
_MUL = np.uint64(0x9E3779B97F4A7C15)


def id_kinds(own: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(kind, hash) of each id: 0 no word, 1 begins one, 2 goes on with one. Ids that differ in case only have one hash."""
    vocab = own.tokenizer.get_vocab(with_added_tokens=True)
    added = {t.content for t in own.tokenizer.get_added_tokens_decoder().values()}
    kind, name = np.zeros(len(own.bytes_of), dtype=np.uint8), np.zeros(len(own.bytes_of), dtype=np.uint64)
    for token, i in vocab.items():
        body = token.removeprefix("Ġ")  # how byte-level BPE writes a space
        if token not in added and any(c.isalnum() for c in body):
            kind[i] = 1 if body != token else 2
            name[i] = np.uint64(hash_of(body.lower()))
    return kind, name


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())


def word_hashes(ids: np.ndarray, first: np.ndarray, kind: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word; first: where each document's ids begin."""
    k = kind[ids]
    before = np.concatenate((np.zeros(1, dtype=np.uint8), k[:-1])) if len(k) else k
    before[first[first < len(k)]] = 0
    start = np.flatnonzero((k == 1) | ((k == 2) & (before == 0)))
    if not len(start):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    word = np.cumsum(_marks(len(k), start)) - 1
    inside = np.flatnonzero(k > 0)
    place = (inside - start[word[inside]]).astype(np.uint64)
    at = np.searchsorted(inside, start)
    h = mixed(np.add.reduceat(mixed(name[ids[inside]] + place * _MUL), at))
    return h, np.searchsorted(first, start, side="right") - 1


def _marks(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[at] = True
    return out


def signatures(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two least hashes of each document's words; the largest number if it has none."""
    out = []
    for salt in (1, 2):
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, doc, (mixed(h + np.uint64(salt)) >> np.uint64(1)).astype(np.int64))
        out.append(low)
    return out[0], out[1]


_STAGED = "row bigint, doc_id bigint, doc_tokens bigint, start bigint, ids binary, sequence_id bigint, sig1 bigint, sig2 bigint, rest boolean"


def tokenised(docs: DataFrame, tokenizer: str, end: int | None, length: int) -> DataFrame:
    """Full windows (with their sequence) and rests of docs (doc_id, text, row). ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, end)
        if not hasattr(own, "kinds"):
            own.kinds = id_kinds(own)
        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, numbers, doc_ids = plain(batch.column("text")), batch.column("row"), batch.column("doc_id")
            for lo, hi in pieces(texts):
                at = lo
                for n, ids, each in own.encode(texts.slice(lo, hi - lo)):
                    first = np.cumsum(each) - each
                    sig1, sig2 = signatures(*word_hashes(ids, first, *own.kinds), n)
                    count = -(-each // length)  # pieces of each document
                    doc = np.repeat(np.arange(n), count)
                    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
                    size = np.minimum(each[doc] - start, length)
                    full = size == length
                    sequence = done + np.cumsum(full)
                    done += int(full.sum())
                    raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
                    body = [raw[4 * a : 4 * b] for a, b in zip((first[doc] + start).tolist(), (first[doc] + start + size).tolist(), strict=True)]
                    of = pa.array(doc)
                    columns = [numbers.slice(at, n).take(of), doc_ids.slice(at, n).take(of), pa.array(each[doc]), pa.array(start), pa.array(body, pa.binary()), pa.array(2 * sequence), pa.array(sig1[doc]), pa.array(sig2[doc]), pa.array(~full)]
                    yield pa.RecordBatch.from_arrays([c.cast(pa.bool_() if i == 8 else pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(columns)], names=[x.split()[0] for x in _STAGED.split(", ")])
                    at += n

    return docs.mapInArrow(run, _STAGED)


class Index:
    """An inverted index of a shard: BM25 weights by word. ids: of each unit."""

    def __init__(self, ids: list[np.ndarray], kind: np.ndarray, name: np.ndarray):
        n = len(ids)
        size = np.array([len(x) for x in ids])
        h, doc = word_hashes(np.concatenate(ids), np.cumsum(size) - size, kind, name)
        _, word = np.unique(h, return_inverse=True)
        both, tf = np.unique(word.astype(np.int64) * n + doc, return_counts=True)
        self.n, self.doc = n, both % n
        self.begin = np.searchsorted(both // n, np.arange(int(both[-1] // n) + 2)) if len(both) else np.zeros(1, dtype=np.int64)
        df = np.diff(self.begin)
        long = np.bincount(doc, minlength=n)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * long[self.doc] / max(1.0, long.mean()))) if len(both) else np.zeros(0)
        # Each unit's words, the most telling first; words of one unit only find nothing.
        of = np.repeat(np.arange(len(df)), df)
        order = np.lexsort((of, -self.weight, self.doc))
        order = order[df[of[order]] > 1]
        self.words, self.words_at = of[order], np.searchsorted(self.doc[order], np.arange(n + 1))

    def scores(self, unit: int, terms: int) -> np.ndarray:
        out = np.zeros(self.n)
        for w in self.words[self.words_at[unit] : self.words_at[unit + 1]][:terms].tolist():
            a, b = self.begin[w], self.begin[w + 1]
            out[self.doc[a:b]] += self.weight[a:b]
        return out


def fill(ids: list[np.ndarray], index: Index, length: int, terms: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (unit, from, to); all full but the last."""
    left = np.array([len(x) for x in ids])
    begin = np.zeros(len(ids), dtype=np.int64)
    out, seed = [], 0
    while True:
        while seed < len(ids) and not left[seed]:
            seed += 1
        if seed == len(ids):
            return out
        now, room = [], length

        def take(u: int, n: int) -> None:
            nonlocal room
            now.append((u, int(begin[u]), int(begin[u]) + n))
            begin[u] += n
            left[u] -= n
            room -= n

        take(seed, int(left[seed]))
        if room:
            score = index.scores(seed, terms)
            score[left == 0] = 0
            near = np.flatnonzero(score)
            near = near[np.argsort(-score[near], kind="stable")]
            size = left[near]
            for u in near.tolist() if len(near) and size.min() <= room else ():
                if left[u] <= room:
                    take(u, int(left[u]))
                    if not room:
                        break
            if room:  # the best that is still there, then the next in order
                some = near[left[near] > 0][:1].tolist()
                at = seed + 1
                while room:
                    while not some and at < len(ids):
                        if left[at]:
                            some = [at]
                        at += 1
                    if not some:
                        break
                    u = some.pop()
                    take(u, min(room, int(left[u])))
        out.append(now)


_PIECES = "doc_id bigint, doc_tokens bigint, start bigint, ids binary, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, end: int | None = 0, length: int = LENGTH, shard: int = SHARD, terms: int = TERMS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc_tokens, start, ids (binary, 4 bytes each), sequence_id, offset for each piece. length: a power of two."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    staged = written(tokenised(rows, tokenizer, end, length), "packing-staged", compression="zstd")
    order = ["sig1", "sig2", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, name = held(("kinds", tokenizer), lambda: id_kinds(Encoder(tokenizer, end)))
        done = TaskContext.get().partitionId() << 40
        units: list[_Unit] = []

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal units, done
            ids = [u[3] for u in units]
            filled = fill(ids, Index(ids, kind, name), length, terms) if units else []
            kept = filled.pop() if filled and sum(b - a for _, a, b in filled[-1]) < length else []
            if last:
                filled += by_powers_of_two(kept)
                kept = []
            doc, total, start, body, sequence, offset = [], [], [], [], [], []
            for s in filled:
                done, at = done + 1, 0
                for u, a, b in s:
                    doc_id, n, first, mine = units[u]
                    doc.append(doc_id)
                    total.append(n)
                    start.append(first + a)
                    body.append(mine[a:b].tobytes())
                    sequence.append(2 * done + 1)
                    offset.append(at)
                    at += b - a
            units = [(units[u][0], units[u][1], units[u][2] + a, units[u][3][a:b]) for u, a, b in kept]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if x is body else pa.int64()) for x in (doc, total, start, body, sequence, offset)], names=["doc_id", "doc_tokens", "start", "ids", "sequence_id", "offset"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start")), batch.column("ids"), strict=True):
                units.append((*row[:3], np.frombuffer(row[3].as_py(), dtype="<u4")))
                if len(units) >= shard:
                    yield packed(False)
        yield packed(True)

    rests = staged.filter("rest").select("doc_id", "doc_tokens", "start", "ids", *order)
    filled = rests.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PIECES)
    return staged.filter("NOT rest").select("doc_id", "doc_tokens", "start", "ids", "sequence_id", F.lit(0).cast("bigint").alias("offset")).unionByName(filled)


_Unit = tuple[int | None, int, int, np.ndarray]


def by_powers_of_two(kept: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces of a sequence cut into sequences whose sizes are powers of two, the largest first."""
    total, out, left = sum(b - a for _, a, b in kept), [], list(kept)
    for bit in reversed(range(total.bit_length())):
        room, now = total & 1 << bit, []
        while room:
            u, a, b = left.pop(0)
            n = min(room, b - a)
            now.append((u, a, a + n))
            room -= n
            if a + n < b:
                left.insert(0, (u, a + n, b))
        if now:
            out.append(now)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (binary), n of each sequence: its pieces put together."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most `length` ids
    whole = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", whole.alias("ids")).withColumn("n", F.octet_length("ids") / 4)
