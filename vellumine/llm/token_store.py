"""A content-addressed store of token ids.

Layout of a store (a folder that Spark can write and read):

* ``chunks/``: key (SHA-256 of the payload), payload (ids as little-endian unsigned integers of `width` bytes). Every
  distinct chunk is there once.
* ``recipes/``: one row for each document, in files by ascending document id: doc_id, part, row (place in the part),
  before (ids of the part's documents before it), n_tokens, digests of its chunks in order, ends (ids up to the end of each), root (SHA-256
  of its digests).
* ``manifest/``: for each part: documents, n_tokens, start (ids of all parts before it) and the Merkle root of its
  documents' roots. `store_root` is the Merkle root over those.

An id stream is cut behind each place where a rolling hash of the last 4 ids has 9 zero bits (512 ids on average), and
after 4,096 ids at most, so equal passages give equal chunks wherever they stand. A task sends each chunk at most once,
so that a passage of a third of the documents doesn't overload the task that keeps it.

`read_documents` rebuilds ids from recipes and chunks. `read_digests` reads every chunk back too, but joins only sizes and
CRCs with the recipes: the CRC of a document follows from those of its chunks. Both verify all they read, and raise where
something was changed or lost: a chunk against its address, a recipe's digests against its root and its ends against its
length, each chunk's length against its place, and each part's documents, ids and Merkle root against the manifest.

Defined results: a null text is an empty one, a document of the end id alone. Repeated rows are documents of their own;
documents of a null id come first. Documents of equal ids stand in the order of their roots. An empty table gives an
empty store. Ids are whole numbers (a text that is none is an error).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.llm.common import fresh_dir
from vellumine.llm.encoder import encoder
from vellumine.llm.words import mixed, pieces, plain

ROLL, CUT_BITS, LONGEST = 4, 9, 4096


@dataclass(frozen=True)
class Store:
    path: str
    width: int = 2

    def part(self, spark: SparkSession, name: str) -> DataFrame:
        schemas = {
            "chunks": "key binary, payload binary",
            "recipes": "doc_id bigint, part int, row bigint, before bigint, n_tokens bigint, digests array<binary>, ends array<bigint>, root binary",
            "manifest": "part int, documents bigint, n_tokens bigint, start bigint, root binary",
        }
        return spark.read.schema(schemas[name]).parquet(f"{self.path}/{name}").withColumnRenamed("key", "digest")


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks end, ascending: at each of `ends` (the documents'), where the rolling hash says so, and after LONGEST ids."""
    g = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    roll = g.copy()
    for j in range(1, ROLL):
        roll[j:] += g[:-j] * np.uint64(2 * j + 1)
    here = np.flatnonzero(mixed(roll) >> np.uint64(64 - CUT_BITS) == 0) + 1
    if len(here):  # not where the hash still covers the document before
        begin = np.concatenate(([0], ends))[np.searchsorted(ends, here - 1, side="right")]
        here = here[here - begin >= ROLL]
    every = np.union1d(here, ends)
    gap = np.diff(every, prepend=0)
    if gap.max(initial=0) > LONGEST:
        long = np.flatnonzero(gap > LONGEST)
        more = [np.arange(every[i] - gap[i] + LONGEST, every[i], LONGEST) for i in long.tolist()]
        every = np.union1d(every, np.concatenate(more))
    return every


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd one moves up as it is. The empty tree's root is the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


_ROWS = "kind string, key binary, payload binary, doc_id bigint, n_tokens bigint, digests array<binary>, ends array<bigint>"


def _encoded(docs: DataFrame, tokenizer: str, end: int | None, width: int) -> DataFrame:
    """Rows of two kinds from one pass over the texts: chunks that are new to the task, and recipes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sent = encoder(tokenizer, end), set()
        for batch in batches:
            texts, doc_ids = plain(batch.column("text")), batch.column("doc_id")
            for lo, hi in pieces(texts):
                at = lo
                for n, ids, each in own.encode(texts.slice(lo, hi - lo)):
                    yield _rows(doc_ids.slice(at, n), ids, each, sent)
                    at += n

    def _rows(doc_ids: pa.Array, ids: np.ndarray, each: np.ndarray, sent: set[bytes]) -> pa.RecordBatch:
        if len(ids) and int(ids.max()) >= 1 << 8 * width:
            raise ValueError(f"an id doesn't fit into {width} bytes")
        ends = np.cumsum(each)
        stop = cuts(ids, ends) if len(ids) else np.zeros(0, dtype=np.int64)
        stop = stop[stop > 0]
        raw = ids.astype(f"<u{width}").tobytes()
        begin = np.concatenate(([0], stop[:-1])) if len(stop) else stop
        body = [raw[a * width : b * width] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        digests = [hashlib.sha256(x).digest() for x in body]
        new = {d: x for d, x in zip(digests, body, strict=True) if d not in sent}
        sent.update(new)
        first = np.searchsorted(stop, np.concatenate(([0], ends)), side="right").astype(np.int32)
        keys = [hashlib.sha256(b"".join(digests[a:b])).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        n, m = len(new), len(doc_ids)
        lists = pa.concat_arrays([pa.nulls(n, pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array(first), pa.array(digests, pa.binary()))])
        upto = pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(first), pa.array(stop - np.repeat(ends - each, np.diff(first))))])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["chunk"] * n + ["recipe"] * m, pa.string()),
                pa.array([*new, *keys], pa.binary()),
                pa.array([*new.values(), *[None] * m], pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.int64()), doc_ids.cast(pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(each.astype(np.int64))]),
                lists,
                upto,
            ],
            names=["kind", "key", "payload", "doc_id", "n_tokens", "digests", "ends"],
        )

    return docs.mapInArrow(run, _ROWS)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk once: equal keys are in one partition."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), strict=True):
            keep.append(kind != "chunk" or key not in seen)
            if kind == "chunk":
                seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        m = len(n)
        run = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.full(m, part, dtype=np.int32)), pa.array(np.arange(row, row + m)), pa.array(run - n), batch.column("n_tokens"), batch.column("digests"), batch.column("ends"), batch.column("root")],
            names=["doc_id", "part", "row", "before", "n_tokens", "digests", "ends", "root"],
        )
        row, before = row + m, int(run[-1]) if m else before


def _rooted(_: tuple, group: pa.Table) -> pa.Table:
    group = group.sort_by("row")
    n = int(np.sum(group.column("n_tokens").to_numpy()))
    return pa.table([[group.column("part")[0].as_py()], [group.num_rows], [n], [merkle(group.column("root").to_pylist())]], schema=pa.schema([("part", pa.int32()), ("documents", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]))


def write_store(docs: DataFrame, tokenizer: str, end: int | None = 0, width: int = 2, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> Store:
    """Encodes docs and writes a store. path: a folder that Spark can write; one in the cluster's shared folder by default."""
    spark = docs.sparkSession
    store = Store(path or fresh_dir(spark, "token-store"), width)
    rows = _encoded(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")), tokenizer, end, width)
    # Copies have equal recipes: their ids spread them.
    once = rows.repartition(F.xxhash64("key", "doc_id")).mapInArrow(_once, _ROWS)
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{store.path}/staged")
    staged = spark.read.schema(_ROWS).parquet(f"{store.path}/staged")
    # The chunks stay where they are: the folder of their kind becomes chunks/.
    _move(spark, f"{store.path}/staged/kind=chunk", f"{store.path}/chunks", "key binary, payload binary")
    recipes = staged.filter("kind = 'recipe'").select("doc_id", "n_tokens", "digests", "ends", F.col("key").alias("root"))
    # Equal ids are dealt by the root as well, so that a repeated document doesn't land in one task.
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.mapInArrow(_numbered, "doc_id bigint, part int, row bigint, before bigint, n_tokens bigint, digests array<binary>, ends array<bigint>, root binary").write.option("compression", "zstd").parquet(f"{store.path}/recipes")
    _drop(spark, f"{store.path}/staged")
    light = store.part(spark, "recipes").select("part", "row", "n_tokens", "root")
    parts = light.groupBy("part").applyInArrow(_rooted, "part int, documents bigint, n_tokens bigint, root binary")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts.select("part", "documents", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("bigint").alias("start"), "root").write.parquet(f"{store.path}/manifest")
    return store


def _move(spark: SparkSession, src: str, dst: str, schema: str) -> None:
    """Renames a folder in Spark's file system; writes an empty table if there was none."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(src), jvm.org.apache.hadoop.fs.Path(dst)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(a):
        spark.createDataFrame([], schema).write.parquet(dst)
    elif not fs.rename(a, b):
        raise OSError(f"{src} can't be renamed to {dst}")


def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def store_root(spark: SparkSession, store: Store) -> bytes:
    """Merkle root over the parts."""
    return merkle([bytes(r.root) for r in store.part(spark, "manifest").orderBy("part").select("root").toLocalIterator()])


_RECIPES = "doc_id bigint, part int, row bigint, before bigint, n_tokens bigint, digests array<binary>, ends array<bigint>"


def verified_recipes(spark: SparkSession, store: Store) -> DataFrame:
    """The recipes, each checked as it is read; the parts are checked against the manifest before."""
    recipes = store.part(spark, "recipes")
    parts = recipes.select("part", "row", "n_tokens", "root").groupBy("part").applyInArrow(_rooted, "part int, documents bigint, n_tokens bigint, root binary")
    told = store.part(spark, "manifest").select(F.col("part").alias("p"), F.col("documents").alias("d"), F.col("n_tokens").alias("n"), F.col("root").alias("r"))
    same = F.col("part").eqNullSafe(F.col("p")) & F.col("documents").eqNullSafe(F.col("d")) & F.col("n_tokens").eqNullSafe(F.col("n")) & F.col("root").eqNullSafe(F.col("r"))
    wrong = parts.join(told, parts["part"] == told["p"], "full_outer").filter(~same).select(F.coalesce("part", "p").alias("part")).first()
    if wrong is not None:
        raise ValueError(f"part {wrong.part} of the store does not match its manifest")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ends, n = batch.column("digests"), batch.column("ends"), batch.column("n_tokens").to_numpy()
            for root, digests in zip(batch.column("root").to_pylist(), lists.to_pylist(), strict=True):
                if hashlib.sha256(b"".join(digests)).digest() != root:
                    raise ValueError("a recipe does not match its root")
            size, flat = ends.value_lengths().to_numpy(), ends.flatten().to_numpy()
            last = np.zeros(len(n), dtype=np.int64)
            some = np.flatnonzero(size)
            last[some] = flat[np.cumsum(size)[some] - 1]
            if (size != lists.value_lengths().to_numpy()).any() or (last != n).any():
                raise ValueError("a recipe's ends do not match its length")
            yield batch.select(["doc_id", "part", "row", "before", "n_tokens", "digests", "ends"])

    return recipes.mapInArrow(check, _RECIPES)


def _chunk_places(recipes: DataFrame, *more: str) -> DataFrame:
    """part, row, more..., at, digest, ids_told (how many ids the chunk must have), after (ids behind it) for each chunk of a recipe."""
    each = recipes.select("part", "row", *more, "n_tokens", "ends", F.posexplode_outer("digests").alias("at", "digest"))
    end, begin = F.element_at("ends", F.col("at") + 1), F.coalesce(F.get("ends", F.col("at") - 1), F.lit(0))
    return each.select("part", "row", *more, "at", "digest", (end - begin).alias("ids_told"), (F.col("n_tokens") - end).alias("after"))


def read_documents(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, part, row, start, ids: every document rebuilt from its chunks, all of it verified."""
    chunks = store.part(spark, "chunks")
    each = _chunk_places(verified_recipes(spark, store), "doc_id", "before")
    whole = each.join(chunks, "digest", "left").groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.first("before").alias("before"), F.array_sort(F.collect_list(F.struct("at", "digest", "ids_told", "payload"))).alias("chunks"))
    width = store.width

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for row in batch.column("chunks").to_pylist():
                for c in row:
                    if c["digest"] is not None and (c["payload"] is None or hashlib.sha256(c["payload"]).digest() != c["digest"] or len(c["payload"]) != width * c["ids_told"]):
                        raise ValueError("a chunk is missing or does not match its address")
                ids.append(np.frombuffer(b"".join(c["payload"] or b"" for c in row), dtype=f"<u{width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "row", "before")), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "part", "row", "before", "ids"])

    rows = whole.select("doc_id", "part", "row", "before", "chunks").mapInArrow(rebuild, "doc_id bigint, part int, row bigint, before bigint, ids array<int>")
    starts = store.part(spark, "manifest").select("part", "start")
    return rows.join(starts, "part").select("doc_id", "part", "row", (F.col("start") + F.col("before")).alias("start"), "ids")


#: The CRC-32 polynomial, bit-reversed.
_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC polynomial, bit-reversed."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    out = np.zeros_like(b)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), b >> np.uint64(1) ^ _POLY, b >> np.uint64(1))
    return out


def crc_before(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a part with this CRC-32 adds (by exclusive or) to the CRC of a whole in which `after` bytes follow."""
    power = np.full(len(crc), 1 << 31, dtype=np.uint64)  # one
    square = np.array([1 << 23], dtype=np.uint64)  # a byte: x to the 8
    left = after.astype(np.int64)
    while len(left) and left.any():
        odd = np.flatnonzero(left & 1)
        power[odd] = _times(np.broadcast_to(square, len(odd)), power[odd])
        square, left = _times(square, square), left >> 1
    return _times(power, crc)


def read_digests(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) for each document, from the files."""
    width = store.width

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for digest, payload in zip(batch.column("digest"), batch.column("payload"), strict=True):
                body = payload.as_py()
                if hashlib.sha256(body).digest() != digest.as_py():
                    raise ValueError("a chunk does not match its address")
                ids = np.frombuffer(body, dtype=f"<u{width}")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["digest", "ids", "crc"])

    chunks = store.part(spark, "chunks").mapInArrow(check, "digest binary, ids bigint, crc bigint")
    recipes = verified_recipes(spark, store)
    placed = _chunk_places(recipes).filter("digest IS NOT NULL")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("ids").null_count:
                raise ValueError("a recipe names a chunk that is not in the store")
            if (batch.column("ids").to_numpy() != batch.column("ids_told").to_numpy()).any():
                raise ValueError("a chunk does not fit its place in a recipe")
            term = crc_before(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), batch.column("ids"), pa.array(term.astype(np.int64))], names=["part", "row", "ids", "term"])

    terms = placed.join(chunks, "digest", "left").select("part", "row", "ids", "ids_told", "crc", "after").mapInArrow(shift, "part int, row bigint, ids bigint, term bigint")
    read = terms.groupBy("part", "row").agg(F.sum("ids").alias("n_tokens"), F.bit_xor("term").alias("crc"))
    starts = store.part(spark, "manifest").select("part", "start")
    rows = store.part(spark, "recipes").select("doc_id", "part", "row", "before")
    both = rows.join(read, ["part", "row"], "left").join(F.broadcast(starts), "part")  # a row for each part: at most the number of partitions
    return both.select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce("crc", F.lit(0)).cast("bigint").alias("ids_crc32"))
