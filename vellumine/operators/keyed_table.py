"""A table by key in buckets: a change reads and writes only the buckets that have its keys.

The table is Parquet, partitioned by `bucket`, a hash of the key; the number of buckets belongs to the table and is never
changed. Changed buckets are written beside the old ones and take their place when all of them are written (Spark's dynamic
overwrite of partitions), so a lost executor costs only its tasks. There must be one writer. The driver moves bucket
after bucket into place; if the driver itself is lost within that step, a bucket may be missing from its place.

Defined results: rows without a key are left out; of the rows of a change that share a key one must have been chosen
before; a change without rows touches nothing; the same change made again gives the same table. A column of the caller
may not be named `bucket`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vellumine.operators.jobs import keyed_update, upsert


@dataclass
class KeyedTable:
    """path: a folder that driver and executors share. schema: of the rows, without the bucket."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = 256

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        known = rows.filter(F.col(self.key).isNotNull())
        return known.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        """One file a bucket."""
        self._bucketed(rows).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> KeyedTable:
        self._write(rows.select(*self.schema.names))
        return self

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other folder is read."""
        stored = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        every = self.spark.read.schema(stored).parquet(self.path)
        return (every if buckets is None else every.filter(F.col("bucket").isin(buckets))).select(*self.schema.names)

    def touched(self, change: DataFrame) -> list[int]:
        """The buckets of a change: at most as many as the table has."""
        return sorted(r.bucket for r in self._bucketed(change).select("bucket").distinct().collect())

    def upsert(self, change: DataFrame, now: Column) -> list[int]:
        """Inserts rows or puts them over those of the same key; which buckets were written."""
        at = self.touched(change)
        if at:
            self._write(upsert(self.rows(at), change.filter(F.col(self.key).isNotNull()), self.key, now))
        return at

    def update(self, change: DataFrame, columns: list[str], now: Column) -> list[int]:
        """Sets some columns of rows that are there; inserts none."""
        at = self.touched(change)
        if at:
            self._write(keyed_update(self.rows(at), change, self.key, columns, now))
        return at
