"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of `bucket` vectors of like length. A query needs a score of at least its
threshold; in a bucket whose longest vector is m, that is a cosine of at least t = threshold / (|q| m). If t > 1 the
bucket is left out for this query: length pruning. If t is above `coordinate_from`, coordinate pruning: a unit vector at
cosine t or more from q has its component on each axis within q_f t +- sqrt((1 - q_f^2)(1 - t^2)), so vectors are looked at
only if they are within it on the query's largest axes. Else only each vector's own length counts. What remains is verified
by exact integer products, and raises the threshold.

The first thresholds come from the `longest` vectors of all, a bounded number that executors compare every query with; they
are lower bounds, so nothing is lost. A query can only be answered by buckets of at least threshold / |q|; queries are sorted
by that need and cut into blocks of `block`. A block and a bucket that can matter to it are one group of one task, which holds
no more than the two; the k best of each query in each bucket are merged at the end. The driver sees one number a block.

Components are integers floor(scale * x). Defined results: vectors that are null, or hold a null, NaN or infinity (also
an integer beyond 64 bits), take no part. Vectors of other lengths are compared as if filled with zeros; the empty
vector scores 0. A row is never its own partner; other rows of its vec_id are, and each row that asks is answered. Ties go
to the smaller vec_id; repeated rows each take a rank. Rows of null vec_id take no part. Scores are exact: where sums could
pass 2^53 Python's integers are used, and a score beyond 64 bits is an error. Tables may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import OWN, written


def integers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, or null if one has no such 64-bit integer."""
    x = F.transform(vector, lambda v: F.lit(float(scale)) * v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**62))
    return F.when(vector.isNotNull() & fine, F.transform(x, lambda v: F.floor(v).cast("bigint")))


def _matrix(vectors: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows filled with zeros to a common number of components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(vectors.offsets.to_numpy())
    width = max(dims or 0, int(n.max(initial=0)), 1)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), dtype=np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and (exact.max() >= 2**63 or exact.min() < -(2**63)):
        raise OverflowError("an inner product does not fit into 64 bits")
    return exact.astype(np.int64)


class Queries:
    """A block of queries and the best of each so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, floor_: np.ndarray, k: int):
        self.rows, self.vectors, self.k = rows, vectors, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        #: A score that the k-th best certainly reaches.
        self.floor = floor_.astype(np.float64)
        self.best: list[list[tuple[int, int]]] = [[] for _ in rows]
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.nan_to_num(vectors / self.norm[:, None])
        self.axes = np.argsort(-np.abs(self.unit), axis=1)[:, :3]

    def offer(self, q: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = (rows != self.rows[q]) & (scores >= self.floor[q])
        if not keep.any():
            return
        ids, scores = ids[keep], scores[keep]
        if len(ids) > self.k:
            worst = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= worst], scores[scores >= worst]
        mine = sorted([*self.best[q], *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]
        self.best[q] = mine
        if len(mine) == self.k:
            self.floor[q] = max(self.floor[q], -mine[-1][0])


def search_bucket(queries: Queries, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, coordinate_from: float = 0.6) -> None:
    """One bucket of vectors of like length, for all queries of the block."""
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    longest = norm.max(initial=0.0)
    room = 1e-9  # what rounding may cost; pruning leaves in what is within it
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(np.isneginf(queries.floor), -np.inf, queries.floor / (queries.norm * longest))
    local = np.where(np.isnan(local), -np.inf, local)
    local = np.where((queries.norm * longest == 0) & (queries.floor <= 0), -np.inf, local)
    live = np.flatnonzero(local <= 1 + room)
    by_axis = live[local[live] >= coordinate_from]
    plain = live[local[live] < coordinate_from]
    if len(by_axis):
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = np.nan_to_num(vectors / norm[:, None])
        for q in by_axis.tolist():
            t = min(1.0, local[q])
            kept = np.ones(len(ids), dtype=bool)
            for f in queries.axes[q].tolist():
                u = queries.unit[q, f]
                around = np.sqrt(max(0.0, (1 - u * u) * (1 - t * t))) + room
                kept &= np.abs(unit[:, f] - u * t) <= around + abs(u) * (1 - t)  # holds for every cosine from t to 1
            kept = np.flatnonzero(kept)
            if len(kept):
                queries.offer(q, rows[kept], ids[kept], _products(queries.vectors[q : q + 1], vectors[kept])[0])
    for lo in range(0, len(plain), 256):
        some = plain[lo : lo + 256]
        scores = _products(queries.vectors[some], vectors)
        may = scores >= queries.floor[some][:, None]
        for i in np.flatnonzero(may.any(axis=1)).tolist():
            hit = np.flatnonzero(may[i])
            queries.offer(int(some[i]), rows[hit], ids[hit], scores[i, hit])


def _sorted_blocks(df: DataFrame, size: int, name: str, out: str) -> DataFrame:
    """df, range-partitioned and sorted, written with `out`: the same for each `size` rows of the whole order, however many partitions there are."""
    part, at = OWN + "part", OWN + "at"
    kinds = T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(at, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, mine, dtype=np.int32)), pa.array(np.arange(n, n + m))], names=[*batch.schema.names, part, at])
            n += m

    numbered = written(df.mapInArrow(run, kinds), name)
    before = F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = numbered.groupBy(part).count().select(part, before.alias(OWN + "before"))  # a row for each partition
    return numbered.join(F.broadcast(offsets), part).withColumn(out, F.floor((F.col(OWN + "before") + F.col(at)) / size)).drop(part, at, OWN + "before")


_FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, block: int = 4096, bucket: int = 8192, longest: int = 4096,
          coordinate_from: float = 0.6, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query says, its k best among all other rows."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), integers(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).withColumn("row", F.monotonically_increasing_id())
    # Equal lengths are dealt by row as well: copies of one vector don't meet in one task.
    by_length = rows.repartitionByRange(F.col("norm").desc(), F.xxhash64("row")).sortWithinPartitions(F.col("norm").desc())
    dealt = _sorted_blocks(by_length, bucket, "topk-vectors", "bucket")
    dims = dealt.agg(F.max(F.size("v"))).first()[0] or 1
    head = dealt.orderBy(F.col("norm").desc(), "vec_id").limit(longest).select("row", "vec_id", "v").toArrow()  # a bounded number of rows
    sent = spark.sparkContext.broadcast((head.column("row").to_numpy(), head.column("vec_id").to_numpy(), _matrix(head.column("v").combine_chunks(), dims)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Thresholds: the k-th score among the longest bounds the k-th of all from below; equal scores stay in, so ties are settled at the end."""
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                asked = Queries(part.column("row").to_numpy(), _matrix(part.column("v"), dims), np.full(part.num_rows, -np.inf), k)
                for at in range(0, len(sent.value[0]), 1024):
                    search_bucket(asked, *(x[at : at + 1024] for x in sent.value), coordinate_from)
                with np.errstate(invalid="ignore", divide="ignore"):
                    need = np.where((asked.norm > 0) & np.isfinite(asked.floor), asked.floor / asked.norm, -np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(asked.floor), pa.array(need * (1 - 1e-9 * np.sign(need)))], names=[*part.schema.names, "floor", "need"])

    asked = dealt.filter("q").select("row", "vec_id", "v").mapInArrow(first, "row bigint, vec_id bigint, v array<bigint>, floor double, need double")
    blocks = _sorted_blocks(asked.repartitionByRange("need").sortWithinPartitions("need"), block, "topk-queries", "block")
    least = sorted((r.need, r.block) for r in blocks.groupBy("block").agg(F.min("need").alias("need")).collect())  # a row for each block of queries
    needs, names = np.array([n for n, _ in least]), np.array([b for _, b in least], dtype=np.int64)
    told = spark.sparkContext.broadcast((needs, names))

    def matter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks to which a bucket can matter."""
        for batch in batches:
            for at, most in zip(batch.column("bucket").to_pylist(), batch.column("most").to_pylist(), strict=True):
                some = told.value[1][: np.searchsorted(told.value[0], most, side="right")]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at)), pa.array(some)], names=["bucket", "block"])

    pairs = written(dealt.groupBy("bucket").agg(F.max("norm").alias("most")).mapInArrow(matter, "bucket bigint, block bigint"), "topk-pairs")

    def search(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("row"), right.sort_by([("norm", "descending"), ("row", "ascending")])
        found: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            own = left.column("row").to_numpy()
            asked = Queries(own, _matrix(left.column("v").combine_chunks(), dims), left.column("floor").to_numpy(), k)
            every, ids, mat = right.column("row").to_numpy(), right.column("vec_id").to_numpy(), _matrix(right.column("v").combine_chunks(), dims)
            for lo in range(0, len(every), 1024):
                search_bucket(asked, every[lo : lo + 1024], ids[lo : lo + 1024], mat[lo : lo + 1024], coordinate_from)
            found = [(q, i, v, -s) for q, i, best in zip(own.tolist(), left.column("vec_id").to_pylist(), asked.best, strict=True) for s, v in best]
        cols = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query", "query_id", "vec_id", "score"])

    left = blocks.select("block", "row", "vec_id", "v", "floor").join(pairs, "block").groupBy("bucket", "block")
    right = dealt.select("bucket", "row", "vec_id", "v", "norm").join(pairs, "bucket").groupBy("bucket", "block")
    found = left.cogroup(right).applyInArrow(search, _FOUND)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")  # k rows a bucket at most
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
