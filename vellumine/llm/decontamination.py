"""Benchmark decontamination by winnowing.

Words are taken in 5-grams. Of every 6 neighbouring grams (5 + 6 - 1 = 10 words) the one with the least hash is kept, the
last one if several are; neighbours mostly keep the same, so two in seven places carry a fingerprint. Which one it is follows
from the 10 words alone: any 10 words that a document shares with an item keep the same gram on both sides, so fingerprints
joined by their hash meet in every shared span of 10 words or more. A meeting is extended word by word, to the left and to the
right, at most 5 words each way (all that a window around the gram can have; a longer span has fingerprints further on, whose
pieces are merged with it). It is a hit if 10 words or more agree. Words are compared, so hashes decide nothing alone. An item
of fewer words than a window has one fingerprint, of all its words, and needs no more.

One plan serves benchmarks of any size. A fingerprint is a row with the words around it. Those of the items are also set in a
table of 2 ** `bits` bits (16 MB, whatever the benchmark), which goes to the workers: a document keeps the fingerprints that
the table lets through, and only those meet the items' in a join. What isn't let through can't be a hit; what is let through
by chance (more with very large benchmarks) only costs the join. A gram that stands among different words in more than `FEW`
places of the benchmark isn't compared with each of them: there both sides are joined on the gram and the words that complete
it to a window, which gives the same hits. Documents are written once with their fingerprints, and only those that have some are joined.

Defined results: a null or empty text has no words and no hits; an item without words, or with a null id, takes no
part; rows with the same item id count as one item. Item ids are whole numbers (a text that is none is an error).
Repeated documents are judged each for itself. Tables may be empty. Other columns are ignored. Long texts are read in
parts that share window - 1 words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import OWN, bit_table, dealt_join, release, written
from vellumine.llm.words import ALNUM, Words, grams, is_long, long_text, mixed, pieces, plain, words

WINDOW, GRAM = 10, 5
#: Different surroundings of a gram in the benchmark up to which each is compared.
FEW = 16
_PRINT = "fp bigint, k int, need int, gram string, before array<string>, after array<string>"
_NAMES = ("fp", "k", "need", "gram", "before", "after", "places")
_FOUND = "array<struct<fp:bigint,k:int,need:int,gram:string,before:array<string>,after:array<string>,places:array<bigint>>>"


def winnowed(g: np.ndarray, n: int) -> np.ndarray:
    """For each n neighbours the place of the least, of the last one of equal ones."""
    size = max(0, len(g) - n + 1)
    first = np.arange(size)
    least, at = g[:size].copy(), first.copy()
    for j in range(1, n):
        now = g[j : j + size]
        found = now <= least
        least[found], at[found] = now[found], first[found] + j
    return at


def _parts(texts: pa.Array, shared: int) -> Iterator[tuple[int, int, int, Words]]:
    """(first row, last row + 1, words before, words) of ranges of texts; a long one comes in parts."""
    for lo, hi in pieces(texts):
        if is_long(texts, lo, hi):
            for before, w in long_text(texts.slice(lo, 1), ALNUM, shared):
                yield lo, hi, before, w
        else:
            yield lo, hi, 0, words(texts.slice(lo, hi - lo), ALNUM)


def _prints(w: Words, short: list[int], window: int, gram: int, choose: Callable) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(words of a gram, words that must agree, places, fingerprints): the winnowed grams, and all grams of as many words as short items have."""
    h = w.hashes()
    text_of = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    inside = lambda at, k: text_of[at] == text_of[at + k - 1]
    g = grams(h, gram)
    chosen = choose(g, window - gram + 1)
    at = np.unique(chosen[inside(np.arange(len(chosen)), window)])
    yield gram, window, at, mixed(g[at])
    for k in short:
        every = grams(h, k)
        at = np.arange(len(every))
        at = at[inside(at, k)]
        yield k, k, at, mixed(every[at] + np.uint64(k))


def _around(w: Words, t: int, at: int, k: int, need: int) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """A gram's words, and those before and behind it in text t, the nearest first, as many as can complete it."""
    said = lambda places: tuple(w.data[w.start[i] : w.end[i]].tobytes().decode() for i in places)
    return w.raw(at, k).decode(), said(range(at - 1, max(int(w.first[t]), at - need + k) - 1, -1)), said(range(at + k, min(int(w.first[t + 1]), at + need)))


def item_fingerprints(benchmark: DataFrame, window: int, gram: int, item_col: str, text: str) -> DataFrame:
    """item and a fingerprint with the words around it: all of every item."""
    choose = winnowed
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["item", "fp", "k", "need", "gram", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            ids = batch.column("item").to_pylist()
            for item, body in zip(ids, batch.column("text"), strict=True):
                for _, _, before, w in _parts(pa.array([body.as_py()], pa.string()), window - 1):
                    if len(w) < window and (before or not len(w)):
                        continue
                    short = [len(w)] if len(w) < window else []
                    rows = []
                    for k, need, at, fp in _prints(w, short, window, gram, choose):
                        for i, f in zip(at.tolist(), fp.view(np.int64).tolist(), strict=True):
                            rows.append((item, f, k, need, *_around(w, 0, i, k, need)))
                            if len(rows) == 10_000:
                                yield batch_of(rows)
                                rows = []
                    if rows:
                        yield batch_of(rows)

    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, f"item bigint, {_PRINT}")


def _candidates(w: Words, short: list[int], table: np.ndarray, bits: int, window: int, gram: int, choose: Callable) -> dict[int, dict[tuple, list[int]]]:
    """For the texts that have some: places by (fingerprint, words around it) of the fingerprints that the table lets through."""
    out: dict[int, dict[tuple, list[int]]] = {}
    for k, need, at, fp in _prints(w, short, window, gram, choose):
        place = (fp >> np.uint64(64 - bits)).astype(np.int64)
        known = np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        text_of = np.searchsorted(w.first, at[known], side="right") - 1
        for t, i, f in zip(text_of.tolist(), at[known].tolist(), fp.view(np.int64)[known].tolist(), strict=True):
            out.setdefault(t, {}).setdefault((f, k, need, *_around(w, t, i, k, need)), []).append(i - int(w.first[t]))
    return out


def _agreeing(a: str, b: str) -> Column:
    """How many words, from the first on, two lists have in common."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same))


def _completed(rows: DataFrame) -> DataFrame:
    """A row for each way to complete a gram to a window by the words around it: `key` stands for the way and its words."""
    way = lambda n: F.xxhash64(n, F.slice("before", 1, n), F.slice("after", 1, F.col("need") - F.col("k") - n))
    ways = F.sequence(F.greatest(F.lit(0), F.col("need") - F.col("k") - F.size("after")), F.least(F.col("need") - F.col("k"), F.size("before")))
    possible = rows.filter(F.size("before") + F.size("after") >= F.col("need") - F.col("k"))
    return possible.withColumn("key", F.explode(F.transform(ways, way)))


def _meetings(found: DataFrame, contexts: DataFrame, few: int) -> DataFrame:
    """Fingerprints of documents (row, print, places) beside those of items (`of`) that have the same hash and can agree in a window."""
    counts = contexts.groupBy("fp").count()
    near = contexts.join(counts.filter(F.col("count") <= few), "fp").groupBy("fp").agg(F.collect_list("of").alias("near"))
    met = dealt_join(found, near, ["fp"], OWN + "row").withColumn("of", F.explode("near")).drop("near")
    frequent = counts.filter(F.col("count") > few).select("fp")
    if frequent.isEmpty():
        return met
    items = _completed(contexts.join(frequent, "fp").select("fp", "of", "of.k", "of.need", "of.before", "of.after")).select("fp", "key", "of").distinct()
    docs = _completed(found.join(frequent, "fp"))
    return met.unionByName(docs.join(items, ["fp", "key"]).drop("key"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = 27,
                  id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep..., n_words, items (ids that have a hit), spans (word ranges of hits, merged)."""
    choose = winnowed
    of = F.struct("k", "need", "gram", "before", "after")
    prints = written(item_fingerprints(benchmark, window, gram, item_col, item_text).select("item", "fp", of.alias("of"), F.xxhash64(of).alias("context")), "decontamination-items")
    short = sorted(r.k for r in prints.filter("of.need = of.k").select("of.k").distinct().collect())  # less than `window`
    some_items = not prints.isEmpty()
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(prints, ["fp"], bits) if some_items else None)  # 2 ** bits bits
    own = text if text in keep else OWN + "text"
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, *([] if text in keep else [F.col(text).cast("string").alias(own)]))
    others = [f for f in rows.schema.fields if f.name != own or text in keep]
    names = [f.name for f in others]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_words bigint", f"`{OWN}found` {_FOUND}"])
    said = pa.list_(pa.string())
    kind = pa.list_(pa.struct([("fp", pa.int64()), ("k", pa.int32()), ("need", pa.int32()), ("gram", pa.string()), ("before", said), ("after", said), ("places", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts, rest = plain(batch.column(own)), batch.select(names)
            done, n, found = -1, [], {}

            def out(lo: int) -> pa.RecordBatch:
                lists = [[dict(zip(_NAMES, (*key, sorted(set(p))), strict=True)) for key, p in found.get(t, {}).items()] for t in range(len(n))]
                return pa.RecordBatch.from_arrays([*rest.slice(lo, len(n)).columns, pa.array(n, pa.int64()), pa.array(lists, kind)], names=[*names, "n_words", OWN + "found"])

            for lo, hi, before, w in _parts(texts, window - 1):
                if lo != done and done >= 0:
                    yield out(done)
                    n, found = [], {}
                done = lo
                n = (np.diff(w.first) + before).tolist()
                for t, mine in (_candidates(w, short, sent.value, bits, window, gram, choose) if some_items else {}).items():
                    for key, places in mine.items():
                        found.setdefault(t, {}).setdefault(key, []).extend(p + before for p in places)
            # The words of a long text are counted by its last part; one without words has no part.
            if done >= 0:
                yield out(done)

    marked = written(rows.mapInArrow(run, schema).withColumn(OWN + "row", F.monotonically_increasing_id()), "decontamination-rows")
    none = marked.filter(F.size(OWN + "found") == 0)
    some = marked.filter(F.size(OWN + "found") > 0)
    found = some.select(OWN + "row", F.explode(OWN + "found").alias("f")).select(OWN + "row", "f.*")
    met = _meetings(found, prints.select("fp", "of").distinct(), FEW)
    alike = met.filter((F.col("need") == F.col("of.need")) & (F.col("gram") == F.col("of.gram")))
    extended = alike.withColumn("left", _agreeing("before", "of.before")).withColumn("right", _agreeing("after", "of.after"))
    hits = extended.filter(F.col("left") + F.col("k") + F.col("right") >= F.col("need"))
    of_items = prints.withColumnRenamed("of", "other")
    seen = hits.select(OWN + "row", "fp", "of").distinct().withColumn("context", F.xxhash64("of"))
    named = seen.join(of_items, ["fp", "context"]).filter(F.col("of") == F.col("other"))
    items = named.select(OWN + "row", "item").distinct().groupBy(OWN + "row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # Spans begin where no window began or reached before.
    ends = hits.select(OWN + "row", F.explode("places").alias("at"), "k", "left", "right").select(OWN + "row", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("k") + F.col("right")).alias("stop"))
    starts = ends.groupBy(OWN + "row", "start").agg(F.max("stop").alias("stop"))
    order = Window.partitionBy(OWN + "row").orderBy("start")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = starts.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy(OWN + "row", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy(OWN + "row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    empty = lambda c, of: F.coalesce(F.col(c), F.array().cast(f"array<{of}>")).alias(c)
    span = "struct<start:bigint,stop:bigint>"
    hit = some.join(items, OWN + "row", "left").join(spans, OWN + "row", "left").select(*names, "n_words", empty("items", "bigint"), empty("spans", span))
    return none.select(*names, "n_words", F.array().cast("array<bigint>").alias("items"), F.array().cast(f"array<{span}>").alias("spans")).unionByName(hit)


def n_hit(spans: str = "spans"):
    """Words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
