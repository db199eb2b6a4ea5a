"""A Merkle manifest of a table: checkpoint and recompute, in DataFrame functions.

Each row is a leaf. Leaves of one source, in the order of their ids, are the bottom of a tree; `arity` consecutive nodes
become one node of the level above, until one is left, the source's subroot. Subroots, in the order of their sources, are
the leaves of one more such tree, whose last node is the root of the table.

`write_manifest` persists only the levels 0, `every`, 2 * `every` and so on of each tree. A node of a stored level, the
next stored node above it and all between them form an aligned subtree of at most arity ** every stored nodes.
`read_proofs` goes from the root down: for each aligned subtree it reads the stored nodes at its bottom, computes the
missing interior nodes, puts each node's siblings in front of those that the subtree's top already has, and drops the
interior nodes again. A subtree is one row, so no task holds a source, however large; only light columns are shuffled, never texts.

A proof is an array of steps from the leaf to the root, each with the digests before and after the node in its run. `fold`
recomputes a root from a leaf and a proof.

Defined results: a null field is `-` and differs from an empty one. Rows of a null source are a tree of their own, before
all others; rows of a null id come first in their source. Rows of one id stand in the order of their leaves; equal rows are
leaves of their own, with equal proofs up to their places. A source of one row has its leaf as subroot; a table of one source has that
subroot as root. An empty table has no leaves and no root. Other columns are ignored unless `keep` names them; their names may
be any. Long texts are hashed where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm.common import OWN, fresh_dir, shuffled_by_range

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, EVERY = 16, 2
STEPS = "array<struct<before:string,after:string>>"


def leaf(*fields: Column) -> Column:
    """The digest of a row, as hex text: of each field `-` if null, else its length in bytes, a colon and its text."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, digest, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings(steps: Column) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass(frozen=True)
class Manifest:
    """Where the tables lie and how many stored levels each kind of tree has. Tables: `leaves`, `nodes-K` (stored level K of the sources' trees, from 1),
    `subroots` (level 0 of the upper tree), `upper-K`, `root`."""

    path: str
    levels: int
    upper_levels: int
    arity: int = ARITY
    every: int = EVERY

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def root(self, spark: SparkSession) -> str | None:
        found = self.table(spark, "root").first()
        return found and found.digest


def _tree_key(source: Column) -> Column:
    """Sorts as the sources do by bytes, null first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _placed(rows: DataFrame, tree: str, order: list[Column], path: str) -> DataFrame:
    """rows with `at`, their place in their tree, and `n`, the tree's size. Ranges of the order are counted, so that a tree spreads over many tasks."""
    shuffled_by_range(rows, order, "__vq_part", "__vq_index").write.parquet(path)
    ranges = rows.sparkSession.read.parquet(path)
    each = ranges.groupBy(tree, "__vq_part").agg(F.min("__vq_index").alias("first"), F.count("*").alias("size"))  # a row for each range and tree in it
    run = Window.partitionBy(tree).orderBy("__vq_part")
    before = F.coalesce(F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = each.select(tree, "__vq_part", (before - F.col("first")).alias("shift"), F.sum("size").over(Window.partitionBy(tree)).alias("n"))
    return ranges.join(shift, [tree, "__vq_part"]).withColumn("at", F.col("__vq_index") + F.col("shift")).drop("__vq_part", "__vq_index", "shift")


def _subtrees(nodes: DataFrame, span: int, *keep: str) -> DataFrame:
    """tree, n, block, nodes (at most `span`, in order: at, digest, keep...): the aligned subtrees over a stored level."""
    return nodes.groupBy("tree", F.floor(F.col("at") / span).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "digest", *keep))).alias("nodes"))


def _run(digests: Column, i: Column, arity: int) -> Column:
    return F.slice(digests, i * arity + 1, F.lit(arity))


def _above(digests: Column, arity: int) -> Column:
    """The level above some digests."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / arity).cast("int")), lambda i: F.sha2(F.array_join(_run(digests, i, arity), ""), 256))


def _climb(nodes: DataFrame, span: int, arity: int, every: int) -> DataFrame:
    """tree, block, n, digest: each subtree's top."""
    blocks = _subtrees(nodes, span).withColumn("digests", F.col("nodes.digest"))
    size = F.col("n")
    for _ in range(every):  # one column a level: nested expressions would compute a level several times
        blocks = blocks.withColumn("digests", F.when(size > 1, _above(F.col("digests"), arity)).otherwise(F.col("digests")))
        size = F.ceil(size / arity).cast("long")
    return blocks.select("tree", "block", "n", F.col("digests")[0].alias("digest"))


def _write_tree(spark: SparkSession, path: str, bottom: str, names: str, roots: str, arity: int, every: int) -> int:
    """Writes the stored levels above the table `bottom` (tree, at, n, digest) and the table of roots; how many levels are stored, the bottom included."""
    span, level, name, done = arity**every, 0, bottom, []
    while True:
        tops = _climb(spark.read.parquet(f"{path}/{name}").select("tree", "at", "n", "digest"), span, arity, every)
        tops.withColumn("last", F.col("n") <= span).write.partitionBy("last").parquet(f"{path}/{names}-tops-{level + 1}")
        tops = spark.read.schema("tree string, block bigint, n bigint, digest string, last boolean").parquet(f"{path}/{names}-tops-{level + 1}")
        done.append(tops.filter("last").select("tree", "digest"))
        more = tops.filter("NOT last").select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / span).cast("long").alias("n"), "digest")
        level += 1
        if more.isEmpty():
            break
        name = f"{names}-{level}"
        more.write.parquet(f"{path}/{name}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out.write.parquet(f"{path}/{roots}")
    return level


def write_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source: str = "source", arity: int = ARITY, every: int = EVERY,
                   path: str | None = None, keep: dict[str, Column] | None = None) -> Manifest:
    """Writes the manifest of docs. keep: further columns of the leaves, by name."""
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "merkle")
    more = {OWN + k: c for k, c in (keep or {}).items()}
    own = [F.col(id_col).alias("doc_id"), _tree_key(F.col(source)).alias("tree"), leaf(*(F.col(f) for f in fields)).alias("digest")]
    docs.select(*own, *(c.alias(k) for k, c in more.items())).write.parquet(f"{path}/hashed")
    hashed = spark.read.parquet(f"{path}/hashed").withColumn("__vq_row", F.monotonically_increasing_id())
    order = [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("__vq_row")]  # the last spreads equal rows
    _placed(hashed, "tree", order, f"{path}/ranges").drop("__vq_row").write.parquet(f"{path}/leaves")
    levels = _write_tree(spark, path, "leaves", "nodes", "subroots-by-source", arity, every)
    subroots = spark.read.parquet(f"{path}/subroots-by-source").select(F.lit("").alias("whole"), F.col("tree").alias("source"), "digest")
    placed = _placed(subroots, "whole", [F.col("source")], f"{path}/upper-ranges")
    placed.select(F.col("whole").alias("tree"), "source", "at", "n", "digest").write.parquet(f"{path}/subroots")
    upper = _write_tree(spark, path, "subroots", "upper", "root", arity, every)
    return Manifest(path, levels, upper, arity, every)


def _down(spark: SparkSession, m: Manifest, bottom: str, names: str, levels: int, tops: DataFrame, *keep: str) -> DataFrame:
    """tree, keep..., digest, steps for each node of the bottom. tops: tree, steps (of each tree's root) and what else is passed down."""
    span = m.arity**m.every
    passed = [c for c in tops.columns if c != "tree"]
    above = None
    for level in reversed(range(levels)):
        nodes = m.table(spark, f"{names}-{level}" if level else bottom)
        kept = () if level else keep
        blocks = _subtrees(nodes, span, *kept).withColumn("d0", F.col("nodes.digest")).withColumn("n0", F.col("n"))
        for k in range(m.every):  # the missing levels, from the stored one
            size = F.col(f"n{k}")
            blocks = blocks.withColumn(f"d{k + 1}", F.when(size > 1, _above(F.col(f"d{k}"), m.arity)).otherwise(F.col(f"d{k}"))).withColumn(f"n{k + 1}", F.ceil(size / m.arity).cast("long"))
        last = tops.withColumn("block", F.lit(0).cast("long"))
        if above is None:
            met = blocks.join(last, ["tree", "block"])
        else:  # trees that end here hang from their roots, larger ones from the level above
            ends = blocks.filter(F.col("n") <= span).join(last, ["tree", "block"])
            met = ends.unionByName(blocks.filter(F.col("n") > span).join(above, ["tree", "block"]))
        each = met.select("*", F.explode("nodes").alias("node")).withColumn("here", (F.col("node.at") % span).cast("int"))
        steps, place = [], F.col("here")
        for k in range(m.every):
            mine, first = F.floor(place / m.arity).cast("int"), place % m.arity
            run = _run(F.col(f"d{k}"), mine, m.arity)
            step = F.struct(F.array_join(F.slice(run, F.lit(1), first), "").alias("before"), F.array_join(F.slice(run, first + 2, F.lit(m.arity)), "").alias("after"))
            steps.append(F.when(F.col(f"n{k}") > 1, F.array(step)).otherwise(F.array().cast(STEPS)))
            place = F.when(F.col(f"n{k}") > 1, mine).otherwise(place)
        own = [F.col(f"node.{c}").alias(c) for c in ("at", "digest", *kept)]
        found = each.select("tree", *own, F.concat(*steps, "steps").alias("steps"), *(c for c in passed if c != "steps"))
        above = found.select("tree", F.col("at").alias("block"), *passed)
    return found.drop("at")


def read_proofs(spark: SparkSession, m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, steps, keep... for each row of the table."""
    root = m.root(spark)
    upper = _down(spark, m, "subroots", "upper", m.upper_levels, m.table(spark, "root").select("tree", F.array().cast(STEPS).alias("steps")), "source")
    tops = upper.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "steps")
    kept = [c for c in m.table(spark, "leaves").columns if c.startswith(OWN)]
    found = _down(spark, m, "leaves", "nodes", m.levels, tops, "doc_id", *kept)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "steps", *(F.col(c).alias(c.removeprefix(OWN)) for c in kept))
