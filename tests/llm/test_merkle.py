"""The Merkle manifest against a plain tree that keeps every level."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from vellumine.llm import merkle

KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string, digest string, tree string, steps string, `at` string, `a.b` string"
more = ("x", "y", "z", "v", "w")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, arity):
    """(root, proof of each leaf: pairs of what is before and after)."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(where):
            run = nodes[p // arity * arity : (p // arity + 1) * arity]
            proofs[i].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        where = [p // arity for p in where]
    return nodes[0], proofs


def plain_manifest(rows, arity):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = mine, *plain_tree([plain_leaf(r) for r in mine], arity)
    root, upper = plain_tree([trees[s][1] for s in names], arity)
    out = []
    for k, s in enumerate(names):
        mine, subroot, proofs = trees[s]
        out += [(r[0], plain_leaf(r), subroot, root, [*p, *upper[k]]) for r, p in zip(mine, proofs, strict=True)]
    return out


def rows(n, sources, seed=1):
    r = random.Random(seed)
    return [(r.choice((i, i, 7, None)), r.choice(sources), r.choice(("en", None)), r.choice((i, None)), r.choice((f"Text {i} é", "", None))) for i in range(n)]


def told(manifest, spark):
    return [(x.doc_id, x.leaf, x.subroot, x.root, [(s.before, s.after) for s in x.steps]) for x in merkle.read_proofs(spark, manifest).collect()]


@pytest.mark.parametrize("n, arity, every, sources", [(700, 2, 2, ("a", "a", "a", "b", "", None, "é", "😀", "￿")), (300, 3, 1, ("a", "a", "b")), (300, 3, 3, ("a", "b", None)), (1, 16, 2, ("a",)), (17, 16, 2, ("a",)), (120, 4, 2, tuple(f"s{i}" for i in range(90)))])
def test_proofs_are_those_of_a_whole_tree(spark, n, arity, every, sources):
    some = rows(n, sources)
    some += some[: n // 3]
    docs = spark.createDataFrame([(*x, *more) for x in some], KIND)
    m = merkle.write_manifest(docs, arity=arity, every=every)
    got = told(m, spark)
    assert sorted(got, key=repr) == sorted(plain_manifest(some, arity), key=repr)
    assert m.root(spark) == got[0][3]
    folded = merkle.read_proofs(spark, m).select((merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root")).alias("same"), F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof"), "steps").collect()
    assert all(x.same and x.proof == sha("".join(s.before + s.after for s in x.steps)) for x in folded)


def test_only_every_few_levels_are_stored(spark):
    docs = spark.createDataFrame([(i, "s", None, None, "t", *more) for i in range(70)], KIND)
    m = merkle.write_manifest(docs, arity=2, every=2)
    sizes = {name: m.table(spark, name).count() for name in ("leaves", "nodes-1", "nodes-2", "nodes-3", "subroots", "root")}
    assert sizes == {"leaves": 70, "nodes-1": 18, "nodes-2": 5, "nodes-3": 2, "subroots": 1, "root": 1} and m.levels == 4  # 70, (35), 18, (9), 5, (3), 2, 1
    assert not any(x.startswith("nodes-4") for x in os.listdir(m.path.removeprefix("file://")))


def test_a_changed_row_is_found(spark):
    some = rows(60, ("a", "b", None), 3)
    docs = spark.createDataFrame([(*x, *more) for x in some], KIND)
    shown = merkle.leaf(*[F.col(f) for f in merkle.FIELDS[:4]], F.upper("text"))
    proofs = merkle.read_proofs(spark, merkle.write_manifest(docs, keep={"shown": shown, "text": F.col("text"), "tree": F.col("tree")}))
    got = proofs.select("text", "tree", (merkle.fold(F.col("shown"), F.col("steps")) == F.col("root")).alias("ok")).collect()
    assert len(got) == 60 and all(x.ok == (not x.text) and x.tree == "y" for x in got)


def test_an_empty_table(spark):
    m = merkle.write_manifest(spark.createDataFrame([], KIND))
    assert told(m, spark) == [] and m.root(spark) is None


def test_a_long_text(spark):
    text = "é" * 2_000_000
    docs = spark.createDataFrame([(1, "a", "en", 5, text, *more), (2, "a", "en", 5, "x", *more)], KIND)
    assert {x[1] for x in told(merkle.write_manifest(docs), spark)} == {plain_leaf((1, "a", "en", 5, text)), plain_leaf((2, "a", "en", 5, "x"))}
