"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.session import prepare

#: Prefix of every column that an operator adds for itself, so that a caller's columns cannot clash.
OWN = "__vq_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only a session whose executors are the driver itself may name none, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; master is {master}")
        named = "file://" + tempfile.mkdtemp(prefix="vellumine-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that blocks of `scratch` will drop, innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, the tables that `written` has made within it, but for those that stay. What still has to be read must be written by then."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, stays: bool = False, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and readable after an executor is lost. stays: not dropped by the block of `scratch` around it."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    for made in _SCRATCH[: len(_SCRATCH) - stays][-1:]:
        made.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled_by_range(df: DataFrame, order: list[Column], part: str, index: str) -> DataFrame:
    """df sorted by the order over all partitions, with each row's partition and its place there. To be written before it is used: another run may cut the ranges elsewhere."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranges.withColumn(part, F.spark_partition_id()).withColumn(index, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, least: int = 1000, most: int = 4096) -> DataFrame:
    """many joined with one (a row for each key). Rows of a key that has more than its share of many, a `most`-th (or `least` rows), are dealt by a
    hash of `by` into as many parts as it has shares, and only its row of one is repeated for each. There are fewer than `most` such keys, so they are
    looked up by broadcast. many is read twice and should be a table."""
    limit = max(least, -(-many.count() // most))
    large = many.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias(OWN + "parts")).collect()
    if not large:
        return many.join(one, keys)
    kind = many.select(*keys).schema.add(OWN + "parts", "integer")
    parts = F.broadcast(many.sparkSession.createDataFrame(large, kind))
    n = F.coalesce(OWN + "parts", F.lit(1))
    left = many.join(parts, keys, "left").withColumn(OWN + "deal", F.pmod(F.xxhash64(by), n).cast("int")).drop(OWN + "parts")
    right = one.join(parts, keys, "left").withColumn(OWN + "deal", F.explode(F.sequence(F.lit(0), n - 1))).drop(OWN + "parts")
    return left.join(right, [*keys, OWN + "deal"]).drop(OWN + "deal")


def bit_table(rows: DataFrame, marks: list[str], bits: int) -> np.ndarray:
    """Which of 2 ** bits places the upper bits of the marks (bigint columns) take; collected in rows of 32,768 bits, so of a size that doesn't depend on the rows."""
    # Spark numbers buckets of 32,768 places from 1, for the places from 1.
    places = rows.select(F.explode(F.array(*marks)).alias("m")).select((F.shiftrightunsigned("m", 64 - bits) + 1).alias("p"))
    each = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(max(1 << bits, 32768) >> 3, dtype=np.uint8)
    for row in each.collect():  # one job; an iterator would run one for each partition
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return out[: 1 << bits >> 3]


_KEPT: dict[str, object] = {}


def kept_value(spark: SparkSession, name: str, make: Callable[[], bytes], read: Callable[[bytes], object]) -> object:
    """What `make` makes, in one task on an executor, once for a shared folder (and read once by a driver process)."""
    path = f"{shared_dir(spark)}/{name}"
    if path not in _KEPT:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            made = spark.range(1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([make()], pa.binary())], names=["value"]) for b in batches if b.num_rows), "value binary")
            made.write.mode("overwrite").parquet(path)
        _KEPT[path] = read(bytes(spark.read.schema("value binary").parquet(path).first().value))
    return _KEPT[path]


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """An object that a worker process keeps from task to task; one at a time, so that the tables of several operators don't add up."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drops what the process holds for another operator, and gives unused memory back."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is (lower() would also change other scripts)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
