"""The worker's numbers by batch, and its health with reasons, over a stream with failing and stuck jobs."""

import datetime as dt

from pyspark.sql import functions as F
from test_keyed_jobs import Worker, row

from vellumine.operators import jobs as J
from vellumine.streaming import keyed_jobs as K


def told(spark, state, time, **more):
    numbers = K.metrics(spark, state)
    r = K.worker_health(numbers, F.lit(time).cast("timestamp"), **more).first()
    return r.status, r.reasons


def test_numbers_and_reasons(spark, tmp_path):
    put = Worker(spark, tmp_path)
    put(11, row("a", "x"), row("b", "bad"), row("e", status=J.COMPLETED))
    first = K.metrics(spark, put.state).orderBy("batch").collect()
    assert [(r.seen, r.taken, r.expired, r.completed, r.failed) for r in first if r.seen] == [(3, 2, 0, 1, 1)]
    soon = dt.datetime(2024, 1, 1, 11, 5)
    assert told(spark, put.state, soon) == ("healthy", [])
    assert told(spark, put.state, soon, model=False) == ("degraded", ["no model is loaded"])
    assert told(spark, put.state, dt.datetime(2024, 1, 1, 11, 30)) == ("degraded", ["no change since 2024-01-01 11:00:00"])
    put(11, row("c", status=J.PROCESSING), row("g", "bad"), row("h", "bad"), minute=1)
    put(11, {"id": None}, minute=20)
    numbers = K.metrics(spark, put.state).agg(*[F.sum(c).alias(c) for c in ("taken", "expired", "completed", "failed")]).first()
    assert tuple(numbers) == (4, 1, 1, 3)
    assert told(spark, put.state, dt.datetime(2024, 1, 1, 11, 21)) == ("degraded", ["3 of 4 jobs failed", "1 jobs were stuck"])


def test_a_worker_without_batches(spark, tmp_path):
    none = spark.createDataFrame([], "batch bigint, seen bigint, taken bigint, expired bigint, completed bigint, failed bigint, at timestamp")
    r = K.worker_health(none, F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")).first()
    assert (r.status, r.reasons) == ("degraded", ["no batch yet"])
