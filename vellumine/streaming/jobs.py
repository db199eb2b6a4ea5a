"""The job worker as a stream: arriving jobs join the table, stuck ones expire, waiting ones are worked on, results are upserted.

State is a folder of numbered Parquet versions, one for each batch, so a batch that is run again writes the same version
again: at least once, with keyed results. Only the version that a repeated batch would read is kept beside the last one. A
job whose id the table has already, or that arrives twice, is one row: the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.operators import jobs as J

JOBS = "id string, posterId bigint, fileName string, filePath string, status string, completed boolean, created timestamp, updated timestamp, error string"
#: Jobs (id, posterId, filePath) to rows (id, error, and the result's columns): an error, or a result.
Worker = Callable[[DataFrame], DataFrame]


def cycle(jobs: DataFrame, work: Worker, now: Column, n: int | None = None, stuck_minutes: int = 5, write: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(jobs afterwards, results). n: jobs to work on, all waiting ones by default."""
    keep = write or (lambda df, name: df)
    live = J.expire_stuck(jobs, now, stuck_minutes)
    taken = J.waiting(live) if n is None else J.next_job(live, n)
    results = keep(work(taken.select("id", "posterId", "filePath")), "results")
    outcome = results.select(F.col("id").alias("__id"), F.col("error").alias("__error"))
    joined = live.join(outcome, live["id"] == outcome["__id"], "left")
    mine = F.col("__id").isNotNull()
    ended = J.mark_completed(J.mark_failed(joined, mine & F.col("__error").isNotNull(), F.col("__error"), now), mine & F.col("__error").isNull(), now)
    return ended.drop("__id", "__error"), results.filter("error IS NULL").drop("error")


def run(spark: SparkSession, incoming: str, state: str, work: Worker, now: Column | None = None, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Starts the stream over a folder of job files (JSON). once: what is there now (on demand); else a batch every so often."""

    def batch(new: DataFrame, number: int) -> None:
        at = now if now is not None else F.current_timestamp()
        before = spark.read.schema(JOBS).parquet(f"{state}/jobs/{number - 1}") if number else spark.createDataFrame([], JOBS)
        fresh = new.join(before.select("id"), "id", "left_anti").withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("created", "filePath"))).filter("__n = 1").select(*new.columns)
        after, results = cycle(before.unionByName(fresh), work, at, write=lambda df, name: _written(spark, df, f"{state}/{name}/{number}"))
        after.write.mode("overwrite").parquet(f"{state}/jobs/{number}")
        results.write.mode("overwrite").parquet(f"{state}/done/{number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/jobs/{number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    writer = spark.readStream.schema(JOBS).json(incoming).writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
