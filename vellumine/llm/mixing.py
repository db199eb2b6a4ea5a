"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions.

`source_targets` shares the total size among sources by weight; no target exceeds `most` times its source's size, and
what is cut off is shared anew by weight (water-filling: the common level rises by Newton steps, each one sum over the
sources, until no more source is full).
`mix` then takes every document of a source floor(target / size) times, and fills what is left of the target with
whole documents in the order of the exponential keys -ln(u) / quality, u a hash of seed, id and text: a weighted sample
without replacement. They are taken up to the document that no longer fits; then, in the same order, those of the rest
that are small enough for what is left, again up to one that doesn't fit; last the one whose size is nearest to what is
then left, if that comes nearer to the target.

The prefix sum over a source needs no task that holds a source: documents are counted in bins of the logarithm of their
key, `bins` for each factor e. An exponential key's logarithm has a density of at most 0.37 whatever the quality, so a bin
holds at most 0.37 / bins of a source. Only the bin in which the target falls is cut once more, into `subs` parts, and
one such part is sorted.

Defined results: a null text has size 0; null source is a source of its own, after all others; a null or not positive
quality counts as 1. Documents of size 0 are never taken. Rows equal in id,
text and source have equal keys; among them the row's number decides, so each counts for itself and any of them may be the last that fits.
An empty table gives no rows. Other columns may have any name; `carry` names those that the result keeps (docs must then give the same rows
in the same partitions whenever it is computed, as a table that is read does, as their rows are judged once more instead of
being written with them). A long text is only counted and hashed where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import OWN, scratch, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """Share of letters and spaces among the characters, 0.05 at least: a weight for texts that nothing else is known about."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(kept / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, the place (from 0) by source, null last: counted within ranges of sources, so that no task holds all of them."""
    order = F.col("source").asc_nulls_last()
    ranges = written(sizes.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mix-sources")
    within = Window.partitionBy("range").orderBy(order)
    each = ranges.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = each.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranges.join(F.broadcast(before.select("range", "before")), "range").withColumn("rank", F.row_number().over(within) - 1 + F.col("before")).drop("range", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, one row a source. weights repeat over sources by code point, null last."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = written(_ranked(sizes).select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap")), "mix-weights")
    total = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # what is shared out at a level is concave in it: Newton steps from below never overshoot, and each fills a source or is the last
        full = F.col("cap") <= level * F.col("weight")
        filled, slope = weighed.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (filled or 0.0)) / slope if slope else level
        if new <= level:
            break
        level = new
    return weighed.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


def sample_key(id_: Column, text: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality, u in (0, 1) a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_, text), 11).cast("double") + 0.5) / float(2**53)
    return F.greatest(-F.log(u) / quality, F.lit(1e-300))


def _by_source(left: DataFrame, right: DataFrame, *cols: str) -> DataFrame:
    """left with cols of right, which has a row for each source. Null source meets null source."""
    named = right.select(F.col("source").alias("__vq_source"), *cols)
    return left.join(named, left["source"].eqNullSafe(named["__vq_source"]), "left").drop("__vq_source")


def _at() -> Column:
    """Where a document stands in its source's order."""
    return F.struct(F.col("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("size"), F.col("row"))


def _prefixes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """source, bin_at, sub_at, to: in the order of the keys, rows before bin_at, before sub_at in it, and up to `to` in that, are the longest beginning
    whose sizes fit into `rest`. rows: source, key, bin, sub, doc_id, size, row; plan: source, rest."""

    def boundary(counted: DataFrame, bin_col: str) -> DataFrame:
        run = Window.partitionBy("source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
        reached = counted.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
        last = reached.filter(F.col("before") <= F.col("rest")).groupBy("source").agg(F.max_by(F.struct(bin_col, "before"), bin_col).alias("at"))
        return last.select("source", F.col(f"at.{bin_col}").alias(f"{bin_col}_at"), F.col("at.before").alias(f"{bin_col}_before"))

    first = _by_source(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")), plan, "rest")
    outer = _by_source(plan, boundary(first, "bin"), "bin_at", "bin_before")
    at_bin = _by_source(rows, outer, "bin_at", "bin_before", "rest").filter("bin = bin_at")
    second = at_bin.groupBy("source", "sub", (F.col("rest") - F.col("bin_before")).alias("rest")).agg(F.sum("size").alias("size"))
    inner = written(_by_source(outer, boundary(second, "sub"), "sub_at", "sub_before"), "mix-plan")
    # In the part of the bin, about 0.37 / (bins * subs) of a source, each document is looked at for itself.
    edge = _by_source(rows, inner, "bin_at", "sub_at", "bin_before", "sub_before", "rest").filter("bin = bin_at AND sub = sub_at")
    run = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("bin_before") - F.col("sub_before") - F.coalesce(F.sum("size").over(run), F.lit(0))
    reach = edge.withColumn("left", left).filter(F.col("left") >= F.col("size")).groupBy("source").agg(F.max(_at()).alias("to"))
    return written(_by_source(inner, reach, "to").select("source", "bin_at", "sub_at", "to"), "mix-plan")


def _before(k: int) -> Column:
    """Does a row belong to the k-th beginning?"""
    bin_at, sub_at, to = (F.col(f"{x}{k}") for x in ("bin_at", "sub_at", "to"))
    within = (F.col("sub") < sub_at) | ((F.col("sub") == sub_at) & F.coalesce(_at() <= to, F.lit(False)))
    return F.coalesce((F.col("bin") < bin_at) | ((F.col("bin") == bin_at) & within), F.lit(False))


def mix(docs: DataFrame, quality: Column | None = None, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 17, bins: int = 128, subs: int = 8192,
        id_col: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carry..., size, source_size, target, copies, taken for each document: copies is how often the mix holds it."""
    q = F.lit(1.0) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    own = [F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), sample_key(F.col(id_col), F.col(text), q, seed).alias("key"), F.monotonically_increasing_id().alias("row")]
    with scratch(docs.sparkSession):
        keyed = written(docs.select(*own), "mix-keys", stays=not carry)
        plan = _plan(keyed, weights, most, bins, subs)
    full = _by_source(_binned(docs.select(*own, *(F.col(c).alias(OWN + str(i)) for i, c in enumerate(carry))) if carry else keyed, bins, subs), plan, *(x for x in plan.columns if x not in ("source", "rest")))
    extra = F.coalesce(_taken() | (_at() == F.col("fill.at")), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.when(extra, 1).otherwise(0)).otherwise(0).cast("long")
    return full.withColumn("copies", copies).select("doc_id", *(F.col(OWN + str(i)).alias(c) for i, c in enumerate(carry)), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _binned(keyed: DataFrame, bins: int, subs: int) -> DataFrame:
    place = F.log("key") * bins
    return keyed.withColumn("bin", F.floor(place)).withColumn("sub", F.floor((place - F.col("bin")) * subs))


def _taken() -> Column:
    """Does a row belong to one of the two beginnings?"""
    return _before(1) | ((F.col("size") <= F.col("gap")) & _before(2))


def _plan(keyed: DataFrame, weights: tuple[float, ...], most: float, bins: int, subs: int) -> DataFrame:
    """What decides about a source's documents: a row for each source."""
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = written(targets.withColumn("epochs", whole.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    rows = ("source", "doc_id", "size", "key", "bin", "sub", "row")

    def used(marked: DataFrame, left: str, now: str) -> DataFrame:
        """plan with what is left of `left` when the rows marked in are taken."""
        total = marked.groupBy("source").agg(F.sum(F.when(F.col("in"), F.col("size")).otherwise(0)).alias("used"))
        return written(_by_source(plan, total, "used").withColumn(now, F.col(left) - F.coalesce("used", F.lit(0))).drop("used"), "mix-plan")

    def with_prefix(found: DataFrame, k: int) -> DataFrame:
        renamed = found.withColumnsRenamed({x: f"{x}{k}" for x in ("bin_at", "sub_at", "to")})
        return _by_source(plan, renamed, f"bin_at{k}", f"sub_at{k}", f"to{k}")

    every = _binned(keyed, bins, subs).filter("size > 0").select(*rows)
    plan = with_prefix(_prefixes(every, plan.select("source", "rest")), 1)
    plan = used(_by_source(every, plan, "bin_at1", "sub_at1", "to1").withColumn("in", _before(1)), "rest", "gap")
    # Of those behind, the ones that are small enough for what is left.
    small = _by_source(every, plan, "bin_at1", "sub_at1", "to1", "gap").filter(~_before(1) & (F.col("size") <= F.col("gap"))).select(*rows)
    plan = with_prefix(_prefixes(small, plan.select("source", F.col("gap").alias("rest"))), 2)
    plan = used(_by_source(small, plan, "bin_at2", "sub_at2", "to2").withColumn("in", _before(2)), "gap", "left")
    off = F.abs(F.col("size") - F.col("left"))
    free = _by_source(every, plan, *(x for x in plan.columns if x[-1] in "12"), "gap", "left").filter(~_taken() & (off < F.col("left")))
    closest = free.groupBy("source").agg(F.min(F.struct(off.alias("off"), _at().alias("at"))).alias("fill"))
    return written(_by_source(plan, closest, "fill"), "mix-plan", stays=True)
