"""The job queue as transforms of a job table: id, posterId, fileName, filePath, status, completed, created, updated, error.

Spark has no row locks: one writer (a streaming batch, or the driver) applies these one after another. `now` is a
parameter, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, PROCESSING, COMPLETED, FAILED = "pending-extraction", "processing", "completed", "failed"
MOST_ERROR = 10_000


def waiting(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~F.col("completed") & (F.col("status") == PENDING))


def next_job(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The oldest waiting jobs; of equal age the least id."""
    return waiting(jobs).orderBy("created", "id").limit(n)


def _set(jobs: DataFrame, which: Column, now: Column, **values: Column) -> DataFrame:
    return jobs.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in {**values, "updated": now}.items()})


def claim(jobs: DataFrame, now: Column, n: int = 1) -> DataFrame:
    """The table after the next jobs were claimed."""
    ids = next_job(jobs, n).select(F.col("id").alias("__id"))
    joined = jobs.join(F.broadcast(ids), jobs["id"] == ids["__id"], "left")  # at most n rows
    return _set(joined, F.col("__id").isNotNull(), now, status=F.lit(PROCESSING)).drop("__id")


def expire_stuck(jobs: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Jobs that have been processed for longer than that fail."""
    limit = now - F.make_dt_interval(mins=F.lit(minutes))
    stuck = (F.col("status") == PROCESSING) & (F.col("updated") < limit)
    return _set(jobs, stuck, now, status=F.lit(FAILED), completed=F.lit(True), error=F.lit(f"Job stuck in processing for over {minutes} minutes; marked failed by cleanup"))


def mark_failed(jobs: DataFrame, which: Column, error: Column, now: Column) -> DataFrame:
    return _set(jobs, which, now, status=F.lit(FAILED), completed=F.lit(True), error=F.left(error, F.lit(MOST_ERROR)))


def mark_completed(jobs: DataFrame, which: Column, now: Column) -> DataFrame:
    """An earlier error stays."""
    return _set(jobs, which, now, status=F.lit(COMPLETED), completed=F.lit(True))


def upsert(target: DataFrame, source: DataFrame, key: str, now: Column) -> DataFrame:
    """target after source's rows were inserted or put over those of the same key. Columns that source lacks become null; created stays.

    One full outer join on the key; source has a row for each key at most."""
    columns = [c for c in target.columns if c not in (key, "created", "updated")]
    new = source.select(F.col(key).alias("__key"), F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(f"__{c}") for c in columns])
    joined = target.join(new, target[key] == new["__key"], "full_outer")
    hit = F.coalesce("__new", F.lit(False))
    return joined.select(
        F.coalesce(key, "__key").alias(key),
        *[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.coalesce("created", now).alias("created"),
        F.when(hit, now).otherwise(F.col("updated")).alias("updated"),
    ).select(*target.columns)


def keyed_update(target: DataFrame, source: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """target with some columns of the rows that source has; nothing is inserted."""
    new = source.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = target.join(new, target[key] == new["__key"], "left")
    return _set(joined, F.col("__key").isNotNull(), now, **{c: F.col(f"__{c}") for c in columns}).select(*target.columns)


def health(gpu: Column, model: Column) -> Column:
    return F.when(gpu & model, "healthy").otherwise("degraded")
