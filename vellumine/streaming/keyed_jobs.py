"""The job worker with a state for each job id, so that a batch reads and writes what its own events touch, never the table.

Events are job rows. The first one of an id makes the job; while it is open, an event of the same id that is completed ends
it; any other event of a known id is a repeat and changes nothing. A waiting job is worked on in the batch that brings it. A
job that arrives as being processed (another worker has it) fails in the first batch whose time is beyond its limit, if no
event has ended it by then, in that batch neither. Time is the latest of the batches' own times (`now`), so no event is ever late;
a row without an id is a tick that only moves time on.

Which ids are known is Spark's own state of a streaming aggregate, a row for each id it has seen, kept and looked up in the
JVM: a stateful processor in Python makes several calls for each id, 1.5 ms of a task in all. Jobs that are open after a batch
are a small table beside it, the only one that a batch writes anew.

Below the state folder: `changes/state/batch=N` and `changes/ended/batch=N` (rows of jobs, the last one of an id counts),
`results/batch=N` and `open/batch=N` (of the last two batches). A batch that is run again overwrites its own folders and starts
from the state before it, so a restart after a failure, also of the work itself, gives the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.operators import jobs as J
from vellumine.streaming.jobs import JOBS, Worker

_FIELDS = ["posterId", "fileName", "filePath", "status", "completed", "created", "updated", "error"]
#: The order of an id's events within a batch: open before ended, then by creation, then by every other field, nulls first.
_ORDER = ["created", "filePath", "posterId", "fileName", "status", "completed", "updated", "error"]
#: Open jobs, and a row without an id for the time (microseconds since 1970).
_OPEN = f"{JOBS}, time bigint"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def touched(events: DataFrame, now: Column) -> DataFrame:
    """A streaming table of job rows to one row for each id that a batch has: whether it is new, its first event and its first
    ending one, and the latest time. Of an id that was known these are of all of its events so far."""
    ended = F.coalesce("completed", F.lit(False))
    job = F.struct(ended.alias("is_end"), *_ORDER)
    # a batch's mark: an id that has one mark only came in this batch
    mark = F.xxhash64(F.lit(uuid.uuid4().hex), F.current_timestamp())
    told = events.select("id", job.alias("job"), F.when(ended, job).alias("end"), F.unix_micros(now.cast("timestamp")).alias("at"), mark.alias("mark"))
    made = told.groupBy("id").agg(F.min("job").alias("first"), F.min("end").alias("end"), F.max("at").alias("at"), F.min("mark").alias("least"), F.max("mark").alias("most"))
    return made.select("id", (F.col("least") == F.col("most")).alias("new"), "first", "end", "at")


def steps(told: DataFrame, before: DataFrame, stuck_minutes: int) -> DataFrame:
    """Jobs that are open before a batch or made by it, after its events and its time: with `changed`, `taken` (this batch is to work on
    it) and `open` (it stays so). told: from `touched`; before: open jobs."""
    time = told.select(F.col("at").alias("time")).unionByName(before.select("time")).agg(F.max("time").alias("time"))
    held = before.filter("id IS NOT NULL").select("id", F.struct(*_FIELDS).alias("held"))
    # an open job has had no ending event before, so its first one is of this batch
    news = told.filter("id IS NOT NULL").select("id", "new", "first", "end")
    job = F.coalesce("held", F.when(F.col("new"), F.struct(*[F.col("first")[f].alias(f) for f in _FIELDS])))
    both = held.join(news, "id", "full").withColumn("job", job).filter("job IS NOT NULL").join(F.broadcast(time))  # time is one row
    ends = F.col("end").isNotNull()
    of_end = lambda f: F.when(ends, F.col("end")[f]).otherwise(F.col("job")[f]) if f in ("status", "completed", "updated", "error") else F.col("job")[f]
    now = both.select("id", *[of_end(f).alias(f) for f in _FIELDS], (F.col("held").isNull() | ends).alias("moved"), "time")
    is_open, no = ~F.coalesce("completed", F.lit(False)), F.lit(False)
    stuck = F.coalesce(is_open & (F.col("status") == J.PROCESSING) & (F.unix_millis("updated") + stuck_minutes * 60_000 < F.floor(F.col("time") / 1000)), no)
    taken = F.coalesce(is_open & (F.col("status") == J.PENDING), no)
    known = now.withColumns({"stuck": stuck, "taken": taken, "open": is_open & ~taken & ~stuck, "changed": F.col("moved") | stuck})
    said = f"Job stuck in processing for over {stuck_minutes} minutes; marked failed by cleanup"
    failed = {"status": F.lit(J.FAILED), "completed": F.lit(True), "updated": F.timestamp_millis(F.floor(F.col("time") / 1000)), "error": F.lit(said)}
    after = known.withColumns({c: F.when(F.col("stuck"), v).otherwise(F.col(c)) for c, v in failed.items()})
    return after.withColumn("status", F.when(F.col("taken"), J.PROCESSING).otherwise(F.col("status"))).drop("moved", "stuck")


def run(spark: SparkSession, events: DataFrame, state: str, work: Worker, now: Column | None = None, stuck_minutes: int = 5, once: bool = True, every: str = "30 seconds") -> StreamingQuery:
    """Starts the worker over a streaming table of job rows (`JOBS`). once: what is there now; else a batch every so often."""
    at = now if now is not None else F.current_timestamp()

    def batch(changed: DataFrame, number: int) -> None:
        path = lambda name, n=number: f"{state}/{name}/batch={n}"
        changed.write.mode("overwrite").parquet(path("touched"))  # read more than once, and Spark's state may be written only once
        told = spark.read.schema(changed.schema).parquet(path("touched"))
        before = spark.read.schema(_OPEN).parquet(path("open", number - 1)) if number else spark.createDataFrame([], _OPEN)
        after = steps(told, before, stuck_minutes)
        after.filter("changed").select("id", *_FIELDS, "taken").write.mode("overwrite").parquet(path("changes/state"))
        clock = told.select(F.col("at").alias("time")).unionByName(before.select("time")).agg(F.max("time").alias("time"))
        after.filter("open").select("id", *_FIELDS).unionByName(clock, allowMissingColumns=True).write.mode("overwrite").parquet(path("open"))
        taken = spark.read.schema(f"{JOBS}, taken boolean").parquet(f"{state}/changes/state/batch={number}").filter("taken").drop("taken")
        work(taken.select("id", "posterId", "filePath")).write.mode("overwrite").parquet(f"{state}/work/batch={number}")
        done = spark.read.parquet(f"{state}/work/batch={number}")
        done.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{state}/results/batch={number}")
        outcome = done.select(F.col("id").alias("__id"), F.col("error").alias("__error"))
        joined = taken.join(outcome, taken["id"] == outcome["__id"])
        ended = J.mark_completed(J.mark_failed(joined, F.col("__error").isNotNull(), F.col("__error"), at), F.col("__error").isNull(), at)
        ended.drop("__id", "__error").write.mode("overwrite").parquet(f"{state}/changes/ended/batch={number}")
        for old in (path("touched"), path("open", number - 2)):
            at_old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            at_old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at_old, True)

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)  # the query copies the session's settings as it starts
    try:
        writer = touched(events, at).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def current(spark: SparkSession, state: str) -> DataFrame:
    """The job table: of each id the last change. One shuffle; a job has three changes at most."""
    steps = [spark.read.schema(f"{JOBS}, batch bigint").parquet(f"{state}/changes/{name}").withColumn("step", F.lit(i)) for i, name in enumerate(("state", "ended"))]
    columns = [c for c in steps[0].columns if c not in ("batch", "step")]
    last = steps[0].unionByName(steps[1]).groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("batch", "step")).alias("job"))
    return last.select("job.*")


def metrics(spark: SparkSession, state: str) -> DataFrame:
    """batch, seen (changed jobs), taken, expired, completed, failed, at (the last change): read from what the batches wrote, so it
    survives the driver, and a batch that is run again is counted once."""
    part = lambda name, more: spark.read.schema(f"{JOBS}, {more}batch bigint").parquet(f"{state}/changes/{name}")
    first, ended = part("state", "taken boolean, "), part("ended", "")
    bad = F.col("status") == J.FAILED
    of_state = first.select("batch", "updated", F.lit(True).alias("seen"), "taken", (bad & F.col("error").startswith("Job stuck")).alias("expired"), F.lit(False).alias("completed"), F.lit(False).alias("failed"))
    of_work = ended.select("batch", "updated", *[F.lit(False).alias(c) for c in ("seen", "taken", "expired")], (F.col("status") == J.COMPLETED).alias("completed"), bad.alias("failed"))
    counts = [F.count_if(F.col(c)).alias(c) for c in ("seen", "taken", "expired", "completed", "failed")]
    return of_state.unionByName(of_work).groupBy("batch").agg(*counts, F.max("updated").alias("at"))


def worker_health(numbers: DataFrame, now: Column, model: bool = True, minutes: int = 10, most_failed: float = 0.5) -> DataFrame:
    """One row: status (healthy, degraded) and its reasons. numbers: from `metrics`. A worker without batches is degraded, too."""
    total = numbers.agg(F.count("*").alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("taken", "expired", "completed", "failed")], F.max("at").alias("at"))
    late = F.col("at") < now - F.make_dt_interval(mins=F.lit(minutes))
    told = F.array_compact(
        F.array(
            F.when(~F.lit(model), F.lit("no model is loaded")),
            F.when(F.col("batches") == 0, F.lit("no batch yet")),
            F.when(late, F.concat(F.lit("no change since "), F.date_format("at", "yyyy-MM-dd HH:mm:ss"))),
            F.when(F.col("failed") > most_failed * (F.col("failed") + F.col("completed")), F.concat("failed", F.lit(" of "), F.col("failed") + F.col("completed"), F.lit(" jobs failed"))),
            F.when(F.col("expired") > 0, F.concat("expired", F.lit(" jobs were stuck"))),
        )
    )
    return total.withColumn("reasons", told).withColumn("status", F.when(F.size("reasons") == 0, "healthy").otherwise("degraded"))
