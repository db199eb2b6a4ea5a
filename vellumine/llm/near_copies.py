"""Near copies: texts are linked if their sets of five-word shingles have a Jaccard similarity of at least
0.8; groups are the connected components. Exact up to collisions of 64-bit hashes.

Copies have one set, and only distinct sets are compared. First op10's method: Golay codewords of SimHash fingerprints give
links of at most 4 of 64 bits that connect their groups (no pairs within a group), and each is verified on the whole sets. What similar sets
differ in more bits (most of those near 0.8) is then found by shared shingles, and only between the groups of the first step.

For that all sets are sorted in one order, frequent shingles (by a sample)
last. Of n shingles a similar set shares at least a = ceil(0.8 n), so two similar sets share at least c of the first
n - a + c of each (c is `SHARED`, or the smaller set's a if that is less). These are the keys. Under a key only pairs meet
whose sizes and places allow the similarity; pairs that meet under fewer than c keys, or under fewer than what is missing behind
one of them, are dropped, and every other pair is verified on the whole sets. The order and the sample change what is looked at, never the result.

Keys of more than `LONG` sets are not expanded into pairs at once. Under each its sets first meet only the `CENTRES` sets that have least of
their own. With the pairs of shorter keys these are verified and grouped; then long keys give the pairs that are in different groups
still and can be similar at all. So every pair is verified, connected, or ruled out by its keys.

A task that finds such pairs holds one key's sets (20 bytes each); pairs leave in slices. To be verified, sets are dealt into
blocks of at most `BLOCK` sets or about `BLOCK_BYTES` of text, those of a group together. A task holds a block's sets, and the
text of each of their partners comes once for a block, not once for a pair. A block compares only what its own links don't connect yet.

Defined results: as `simhash.near_duplicates`. Texts without words are copies of each other and near to nothing else; a
text of fewer than five words has itself as its shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import bit_table, dealt_join, release, scratch, shuffled_by_range, written
from vellumine.llm.simhash import SMALL, components, fingerprints, linked
from vellumine.llm.words import NOT_SPACE, Words, grams, is_long, long_text, mixed, pieces, plain, words

SHINGLE, SIMILARITY, SHARED = 5, 0.8, 8
#: One text of so many is looked at for frequent shingles, and so many of them are known.
SAMPLE, FREQUENT = 32, 1 << 17
#: Pairs that are compared at once.
SLICE = 1 << 20
#: A key of more sets is long: its sets first meet so many of them only, then only what isn't connected yet.
LONG, CENTRES = 32, 16
#: Sets that are verified together, and bytes of their texts.
BLOCK, BLOCK_BYTES = 64, 8 << 20
#: Bits of the hashes by which texts are picked before they are shuffled.
BITS = 26
_SLACK = 1e-9


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's different shingles. A single long text is read in parts that share shingle - 1 words."""
    if is_long(texts, 0, len(texts)):
        parts = [_sets(w, shingle)[0] for before, w in long_text(texts, NOT_SPACE, shingle - 1) if len(w) >= shingle or not before]
        return [np.unique(np.concatenate(parts))]
    return _sets(words(texts, NOT_SPACE), shingle)


def _sets(w: Words, shingle: int) -> list[np.ndarray]:
    h = w.hashes()
    every = grams(np.concatenate((h, np.zeros(shingle - 1, dtype=np.uint64))), shingle)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if 0 < hi - lo < shingle:
            out.append(grams(h[lo:hi], hi - lo))
        else:
            out.append(np.unique(every[lo : max(lo, hi - shingle + 1)]))
    return out


def set_print(s: np.ndarray) -> int:
    """A 64-bit hash of a sorted set; 0 for the empty one."""
    if not len(s):
        return 0
    place = mixed(np.arange(1, len(s) + 1, dtype=np.uint64))
    return int(mixed(np.array([mixed(s ^ place).sum()], dtype=np.uint64))[0])


def least_shared(n: np.ndarray | int, similarity: float) -> np.ndarray:
    return np.ceil(similarity * np.asarray(n) - _SLACK).astype(np.int64)


def set_keys(s: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the order of all sets. common: frequent shingles with their ranks (columns), by shingle."""
    if len(common):
        at = np.minimum(np.searchsorted(common[:, 0], s), len(common) - 1)
        s = s[np.argsort(np.where(common[at, 0] == s, common[at, 1], 0), kind="stable")]
    a = int(least_shared(len(s), similarity))
    return s[: len(s) - a + min(SHARED, a)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


_Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]
_PAIRS, _KEYED = "a bigint, b bigint, least int", ("key", "fp", "n", "place")


def _fitting(fp: np.ndarray, n: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float, met: np.ndarray | None = None) -> _Pairs:
    """Of the pairs x, y those that sizes and places allow: a < b (signed), and under how many keys they must meet: what they share up to a key and all
    that one of them has behind it must be enough. met: how many keys up to this one the set can share, if that is known."""
    low, high, behind = np.minimum(n[x], n[y]), np.maximum(n[x], n[y]), np.minimum(n[x] - 1 - place[x], n[y] - 1 - place[y])
    before = np.minimum(place[x], place[y]) + 1 if met is None else np.minimum(met[x], met[y])
    needed = np.ceil(similarity / (1 + similarity) * (low.astype(np.int64) + high) - _SLACK)
    fits = (fp[x] != fp[y]) & (low >= similarity * high - _SLACK) & (before + behind >= needed)
    a, b = fp[x[fits]], fp[y[fits]]
    least = np.maximum(np.minimum(SHARED, least_shared(low[fits], similarity)), needed[fits] - behind[fits])
    return np.minimum(a, b), np.maximum(a, b), least.astype(np.int32)


def _met(key: np.ndarray, fp: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[_Pairs]:
    """Pairs within the runs of equal keys; whole runs only."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    length = np.repeat(size, size)
    for d in range(1, min(SMALL, int(size.max(initial=1)))):
        x = np.flatnonzero((key[:-d] == key[d:]) & (length[:-d] <= SMALL))
        yield _fitting(fp, n, place, x, x + d, similarity)
    for r in np.flatnonzero(size > SMALL).tolist():
        f, first = np.unique(fp[edge[r] : edge[r + 1]], return_index=True)
        first = first[np.argsort(n[edge[r] + first], kind="stable")] + edge[r]
        f, m, p = fp[first], n[first], place[first]
        # By size: after each set those that are not too large for it.
        count = np.searchsorted(m, np.floor(m / similarity + _SLACK), side="right") - np.arange(1, len(m) + 1)
        told = np.cumsum(count)
        lo = 0
        while lo < len(m):
            hi = max(lo + 1, int(np.searchsorted(told, told[lo] - count[lo] + SLICE, side="right")))
            c = count[lo:hi]
            x = np.repeat(np.arange(lo, hi), c)
            yield _fitting(f, m, p, x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c), similarity)
            lo = hi


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where the runs of equal keys that are long begin and end."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    for r in np.flatnonzero(np.diff(edge) > LONG).tolist():
        yield int(edge[r]), int(edge[r + 1])


def _parted(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of keys that aren't long, and those of long ones, each set once under a key. Whole runs only."""
    short, long = np.ones(len(key), dtype=bool), []
    for lo, hi in _runs(key):
        first = np.unique(fp[lo:hi], return_index=True)[1]
        if len(first) > LONG:
            short[lo:hi] = False
            long.append(first + lo)
    return np.flatnonzero(short), np.concatenate(long) if long else np.zeros(0, dtype=np.int64)


def _central(key: np.ndarray, fp: np.ndarray, n: np.ndarray, place: np.ndarray, met: np.ndarray, similarity: float) -> Iterator[_Pairs]:
    """Of each run of a long key the pairs with the sets that have least of their own before it, which are nearest to what all share."""
    for lo, hi in _runs(key):
        order = np.lexsort((fp[lo:hi], (place[lo:hi] + 1 - met[lo:hi]) / n[lo:hi])) + lo
        for at in range(0, hi - lo, SLICE // CENTRES):
            x, y = np.arange(at, min(hi - lo, at + SLICE // CENTRES)).repeat(CENTRES), np.tile(np.arange(CENTRES), min(hi - lo - at, SLICE // CENTRES))
            yield _fitting(fp, n, place, order[x[y < x]], order[y[y < x]], similarity, met)


def _apart(key: np.ndarray, fp: np.ndarray, n: np.ndarray, place: np.ndarray, met: np.ndarray, root: np.ndarray, similarity: float) -> Iterator[_Pairs]:
    """Of each run of a long key the pairs whose sets aren't in one group; nothing is spent on pairs within the largest group."""
    for lo, hi in _runs(key):
        _, of, size = np.unique(root[lo:hi], return_inverse=True, return_counts=True)
        if len(size) < 2:
            continue
        order = np.lexsort((of, -size[of]))  # the largest group first
        group = of[order]
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        count = begin[np.searchsorted(begin, np.arange(hi - lo), side="right") - 1]  # those of the groups before its own
        order += lo
        told = np.cumsum(count)
        at = 0
        while at < hi - lo:
            to = max(at + 1, int(np.searchsorted(told, told[at] - count[at] + SLICE, side="right")))
            c = count[at:to]
            x = np.repeat(np.arange(at, to), c)
            yield _fitting(fp, n, place, order[x], order[np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c)], similarity, met)
            at = to


def _whole_runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The columns (first the key, which the rows are sorted by) in parts that cut no key."""
    held: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if not len(new[0]):
            continue
        last = int(np.searchsorted(new[0], new[0][-1]))  # the last run may go on in the next batch
        if last or (held[0] and held[0][-1][-1] != new[0][0]):
            yield [np.concatenate([*h, x[:last]]) for h, x in zip(held, new, strict=True)]
            held = [[] for _ in names]
        for h, x in zip(held, new, strict=True):
            h.append(x[last:])
    if held[0]:
        yield [np.concatenate(h) for h in held]


def _each(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[int, np.ndarray, pa.Scalar]]:
    """Each set once a task."""
    seen = set()
    for batch in batches:
        column = plain(batch.column("text"))
        for lo, hi in pieces(column):
            part = column.slice(lo, hi - lo)
            for i, s in enumerate(shingle_sets(part, shingle)):
                if len(s) and (fp := set_print(s)) not in seen:
                    seen.add(fp)
                    yield fp, s, part[i]


def similar(texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, groups: DataFrame | None = None) -> DataFrame:
    """a, b: prints of every two different sets that are similar. texts: text, without nulls. groups (node, root; roots need no row): sets that are
    known to be connected; then only links between groups are found, as many as connect the same sets as all do."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, _ in _each(batches, shingle):
            yield pa.RecordBatch.from_arrays([_signed(s)], names=["key"])

    often = texts.filter(F.xxhash64("text") % SAMPLE == 0).mapInArrow(sampled, "key bigint").groupBy("key").count().filter("count > 2").orderBy(F.desc("count"), "key").limit(FREQUENT).collect()
    common = np.array([[r["key"], r["count"]] for r in often], dtype=np.int64).reshape(-1, 2).view(np.uint64)
    common = common[np.argsort(common[:, 0])]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0

        def out() -> pa.RecordBatch:
            fp, n, keys = zip(*held, strict=True)
            count = [len(k) for k in keys]
            place = np.concatenate([np.arange(c, dtype=np.int32) for c in count])
            return pa.RecordBatch.from_arrays(
                [_signed(np.concatenate(keys)), _signed(np.repeat(np.array(fp, dtype=np.uint64), count)), pa.array(np.repeat(np.array(n, dtype=np.int32), count)), pa.array(place)], names=["key", "fp", "n", "place"]
            )

        for fp, s, _ in _each(batches, shingle):
            held.append((fp, len(s), set_keys(s, common, similarity)))
            size += len(held[-1][2])
            if size > 50_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def paired(pairs: Iterator[_Pairs]) -> Iterator[pa.RecordBatch]:
        for found in pairs:
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "least"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_runs(batches, _KEYED):
            yield from paired(_met(*columns, similarity))

    def meet_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of keys that aren't long; the rows of long ones as they are, a print as a."""
        for columns in _whole_runs(batches, _KEYED):
            short, long = _parted(*columns[:2])
            for batch in paired(_met(*(x[short] for x in columns), similarity)):
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(len(batch), t) for t in (pa.int64(), pa.int32(), pa.int32()))], names=["a", "b", "least", "key", "n", "place"])
            if len(long):
                key, fp, n, place = (pa.array(x[long]) for x in columns)
                yield pa.RecordBatch.from_arrays([fp, pa.nulls(len(long), pa.int64()), pa.nulls(len(long), pa.int32()), key, n, place], names=["a", "b", "least", "key", "n", "place"])

    def meet_central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_runs(batches, (*_KEYED, "met")):
            yield from paired(_central(*columns, similarity))

    def meet_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_runs(batches, (*_KEYED, "met", "root")):
            yield from paired(_apart(*columns, similarity))

    def counted(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a", "b").agg(F.count("*").alias("keys"), F.max("least").alias("least"))

    def between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(groups.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}")), c, "left")
        return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    keyed = texts.mapInArrow(emit, "key bigint, fp bigint, n int, place int").repartition("key").sortWithinPartitions("key")
    if groups is None:
        return verified(texts, written(counted(keyed.mapInArrow(meet, _PAIRS)).filter("keys >= least").select("a", "b"), "copies-pairs"), similarity, shingle)
    found = written(keyed.mapInArrow(meet_short, f"{_PAIRS}, key bigint, n int, place int"), "copies-met")
    short, long = found.filter("key IS NULL").select("a", "b", "least"), found.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"), "n", "place")
    if long.isEmpty():
        return verified(texts, written(between(counted(short).filter("keys >= least"), groups), "copies-pairs"), similarity, shingle, spanning=True)
    # Two sets that meet under no other key share as many keys up to a long one as the less of them has long keys up to there.
    long = long.withColumn("met", F.row_number().over(Window.partitionBy("fp").orderBy("place"))).filter(F.col("met") + F.col("n") - 1 - F.col("place") >= similarity * F.col("n") - _SLACK)
    long = written(long, "copies-long")
    # Pairs that meet under a short key may share all long keys that both have: they are settled here.
    pairs, most = counted(short), written(found.filter("key IS NOT NULL").groupBy(F.col("a").alias("fp")).count(), "copies-long-keys")
    for c in ("a", "b"):
        pairs = pairs.join(most.select(F.col("fp").alias(c), F.col("count").alias(f"long_{c}")), c, "left")
    pairs = pairs.filter(F.col("keys") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))) >= F.col("least")).select("a", "b")
    central = counted(long.repartition("key").sortWithinPartitions("key").mapInArrow(meet_central, _PAIRS)).filter("keys >= least").select("a", "b")
    pairs = written(between(pairs.unionByName(central).distinct(), groups), "copies-pairs")
    links = written(verified(texts, pairs, similarity, shingle, spanning=True), "copies-links")
    known = written(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)), "copies-known")
    rooted = long.join(known.withColumnRenamed("node", "fp"), "fp", "left").select(*_KEYED, "met", F.coalesce("root", "fp").alias("root"))
    apart = counted(rooted.repartition("key").sortWithinPartitions("key").mapInArrow(meet_apart, _PAIRS)).filter("keys >= least").select("a", "b")
    left = written(apart.join(pairs, ["a", "b"], "left_anti"), "copies-pairs-apart")
    return links.unionByName(verified(texts, left, similarity, shingle, spanning=True))


def verified(texts: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, spanning: bool = False) -> DataFrame:
    """The pairs (a, b: different prints of sets of the texts, none empty, each pair once; a table) that are similar. spanning: only as many of them as
    connect the same sets; what a block's links connect already isn't compared."""
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b"))
    marks = texts.sparkSession.sparkContext.broadcast(bit_table(ends, ["fp"], BITS))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, _, text in _each(batches, shingle):
            at = fp >> (64 - BITS)
            if marks.value[at >> 3] >> (at & 7) & 1:
                yield pa.RecordBatch.from_arrays([_signed(np.array([fp], dtype=np.uint64)), pa.array([text.as_py()], pa.string())], names=["fp", "text"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, mine = None, {}
        above: dict[int, int] = {}  # of a set that the block's links connect: another one, towards its group's first

        def top(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = above.get(up, up)
                x = up
            return x

        for batch in batches:
            column = plain(batch.column("text"))
            for lo, hi in pieces(column):
                blocks, a, b, partners = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("block", "a", "b", "partners"))
                found = []
                for i, s in enumerate(shingle_sets(column.slice(lo, hi - lo), shingle)):
                    if blocks[i] != block:
                        block, mine, above = blocks[i], {}, {}
                    if b[i] is None:
                        mine[a[i]] = s
                        continue
                    for x in partners[i]:
                        if spanning and top(x) == top(b[i]):
                            continue
                        both = len(np.intersect1d(mine[x], s, assume_unique=True))
                        if both >= similarity * (len(mine[x]) + len(s) - both) - _SLACK:
                            found.append((x, b[i]))
                            above[top(x)] = top(b[i])
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    needed = ends.distinct()
    met = written(texts.mapInArrow(named, "fp bigint, text string").join(needed, "fp", "left_semi").dropDuplicates(["fp"]), "copies-texts")
    # The sets that lead pairs, by the first set that each meets, so that those of a group stand together.
    least = pairs.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("least"))
    leads = pairs.select(F.col("a").alias("fp")).distinct().join(least, "fp", "left").withColumn("least", F.coalesce("least", "fp"))
    sized = leads.join(met.select("fp", F.octet_length("text").cast("bigint").alias("size")), "fp")
    ranged = written(shuffled_by_range(sized, [F.col("least"), F.col("fp")], "part", "index"), "copies-ranges")
    bytes_ = F.sum("size").over(Window.partitionBy("part").orderBy("index"))
    block = F.struct("part", F.floor(F.col("index") / BLOCK).alias("n"), F.floor(bytes_ / BLOCK_BYTES).alias("m"))
    blocks = ranged.select(F.col("fp").alias("a"), block.alias("block"))
    own = blocks.join(met, blocks["a"] == met["fp"]).select("block", "a", F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("array<bigint>").alias("partners"), "text")
    dealt = pairs.join(blocks, "a").groupBy("block", "b").agg(F.collect_list("a").alias("partners"))  # at most BLOCK
    others = dealt.join(met, dealt["b"] == met["fp"]).select("block", F.lit(None).cast("bigint").alias("a"), "b", "partners", "text")
    return own.unionByName(others).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("b")).mapInArrow(verify, "a bigint, b bigint")


def _golay_links(texts: DataFrame, prints: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """a, b: similar sets within 4 bits, as many as connect the same sets. prints: fp, bits (op10's fingerprint of a text of the set)."""
    some = prints.filter("fp <> 0")
    first = written(some.groupBy("bits").agg(F.min("fp").alias("first")), "copies-bits")
    near = linked(first.select(F.col("bits").alias("fp")), direct=True)
    of = [first.select(F.col("bits").alias(c), F.col("first").alias(f"of_{c}")) for c in ("a", "b")]
    links = near.join(of[0], "a").join(of[1], "b").select(F.col("of_a").alias("x"), F.col("of_b").alias("y"))
    links = links.unionByName(some.join(first, "bits").select(F.col("fp").alias("x"), F.col("first").alias("y"))).filter("x <> y")
    pairs = written(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "copies-golay-pairs")
    return written(verified(texts, pairs, similarity, shingle, spanning=True), "copies-golay-links")


def _grouped(docs: DataFrame, similarity: float, shingle: int, id_col: str, text: str, row: str | None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, row of each document; fp, root, least of each set). least: null or not, id and row of its first document."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            column = plain(batch.column("text"))
            for lo, hi in pieces(column):
                part = column.slice(lo, hi - lo)
                prints = np.array([set_print(s) for s in shingle_sets(part, shingle)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "row")), _signed(prints), _signed(fingerprints(part))], names=["doc_id", "row", "fp", "bits"])

    number = F.lit(None).cast("bigint") if row is None else F.col(row)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), number.alias("row"))
    marked = written(rows.mapInArrow(mark, "doc_id bigint, row bigint, fp bigint, bits bigint"), "copies-prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    prints = written(marked.groupBy("fp").agg(least, F.min("bits").alias("bits")), "copies-distinct")
    texts = rows.select("text")
    near = _golay_links(texts, prints, similarity, shingle)
    roots = components(near.unionByName(similar(texts, similarity, shingle, written(components(near), "copies-golay-groups"))))
    return marked, written(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "copies-groups")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (bigint, of the set), component_id for each document."""
    marked, grouped = _grouped(docs, similarity, shingle, id_col, text, None)
    named = grouped.groupBy("root").agg(F.min("least")["doc_id"].alias("component_id"))
    return dealt_join(marked, dealt_join(grouped, named, ["root"], "fp").select("fp", "component_id"), ["fp"], "doc_id").select("doc_id", "fp", "component_id")


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: that of the least id (of equal ids, and of a group without any, the first row). Rows that share an id
    but not a group all stay. docs must give the same rows in the same partitions whenever it is computed, as a table that is read does."""
    own = "__vq_row"
    rows = docs.withColumn(own, F.monotonically_increasing_id())
    with scratch(docs.sparkSession):
        _, grouped = _grouped(rows, similarity, shingle, id_col, text, own)
        kept = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(own))  # sums up by group before anything is shuffled
        kept = written(kept, "copies-kept", stays=True)
    return rows.join(kept, own, "left_semi").drop(own)
