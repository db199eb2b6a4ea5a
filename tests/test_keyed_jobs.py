import datetime as dt
import http.server
import json
import random
import threading

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vellumine.operators import jobs as J
from vellumine.sources import objects
from vellumine.streaming import keyed_jobs as K
from vellumine.streaming.jobs import JOBS

NOW = dt.datetime(2024, 1, 1, 12, 0)


def work(jobs):
    return jobs.select("id", F.when(F.col("filePath").contains("bad"), "broken").alias("error"), F.upper("filePath").alias("title"))


def row(i, path="x", status=J.PENDING, updated="11:00:00"):
    return {"id": i, "posterId": 1, "filePath": path, "status": status, "completed": status in (J.COMPLETED, J.FAILED), "created": "2024-01-01T11:00:00", "updated": f"2024-01-01T{updated}"}


class Worker:
    def __init__(self, spark, folder):
        self.spark, self.incoming, self.state, self.n = spark, folder / "in", str(folder / "state"), 0
        self.incoming.mkdir()

    def __call__(self, hour, *rows, work=work, minute=0):
        self.n += 1
        (self.incoming / f"{self.n}.json").write_text("\n".join(map(json.dumps, rows)))
        events = self.spark.readStream.schema(JOBS).json(str(self.incoming))
        K.run(self.spark, events, self.state, work, F.lit(dt.datetime(2024, 1, 1, hour, minute)).cast("timestamp")).awaitTermination()
        return self.table()

    def table(self):
        return {r.id: (r.status, r.error) for r in K.current(self.spark, self.state).collect()}


STUCK = (J.FAILED, "Job stuck in processing for over 5 minutes; marked failed by cleanup")


def test_work_expiry_outcomes_and_repeats(spark, tmp_path):
    put = Worker(spark, tmp_path)
    got = put(11, row("a", "x"), row("a", "y"), row("b", "bad"), row("c", status=J.PROCESSING), row("d", status=J.PROCESSING), row("e", status=J.COMPLETED))
    assert got == {"a": (J.COMPLETED, None), "b": (J.FAILED, "broken"), "c": (J.PROCESSING, None), "d": (J.PROCESSING, None), "e": (J.COMPLETED, None)}
    # restarted from its checkpoint: the edge is strict, one job ends in time, repeats change nothing
    got = put(11, row("d", status=J.COMPLETED, updated="11:04:00"), row("a", "again"), row("e"), minute=5)
    assert got["c"] == (J.PROCESSING, None) and got["d"] == (J.COMPLETED, None)
    got = put(11, {"id": None}, minute=6)
    assert got["c"] == STUCK and got["d"] == (J.COMPLETED, None) and len(got) == 5
    # what comes after the failure is too late, and no batch writes jobs of another
    got = put(12, row("c", status=J.COMPLETED), row("f", "new"))
    assert got["c"] == STUCK and got["f"] == (J.COMPLETED, None)
    assert sorted(r.title for r in spark.read.parquet(f"{put.state}/results").collect()) == ["NEW", "X"]
    last = spark.read.parquet(f"{put.state}/changes/state")
    assert last.count() == 8 and {r.id for r in last.groupBy("id").count().filter("count > 1").collect()} == {"c", "d"}


def test_batches_write_what_changes(spark, tmp_path):
    put = Worker(spark, tmp_path)
    put(11, *[row(f"j{i}") for i in range(500)])
    put(12, row("j1"), row("one"))
    sizes = {r.batch: r.n for r in spark.read.parquet(f"{put.state}/changes/state").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sorted(sizes.values()) == [1, 500] and K.current(spark, put.state).count() == 501


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    put = Worker(spark, tmp_path)

    def lost(jobs):
        return jobs.select("id", F.raise_error(F.lit("lost")).cast("string").alias("error"), "filePath")

    with pytest.raises(StreamingQueryException):
        put(11, row("a"), row("b", status=J.PROCESSING), work=lost)
    assert put(12, row("a"), row("b", status=J.PROCESSING)) == {"a": (J.COMPLETED, None), "b": STUCK}
    assert spark.read.parquet(f"{put.state}/results").count() == 1


def test_nulls_and_equal_rows(spark, tmp_path):
    put = Worker(spark, tmp_path)
    blank = {**row("n", None, J.PROCESSING), "updated": None, "created": None}
    got = put(11, blank, blank, {"id": "m"}, row("z"), row("z"))
    assert got == {"n": (J.PROCESSING, None), "m": (None, None), "z": (J.COMPLETED, None)}


@pytest.fixture
def store():
    asked = {}

    class Store(http.server.BaseHTTPRequestHandler):
        jobs: list = []

        def do_GET(self):
            asked[self.path] = n = asked.get(self.path, 0) + 1
            path, _, query = self.path.partition("?")
            bounds = dict(p.split("=") for p in query.split("&")) if query else {}
            code, body = 404, b""
            if self.headers["AccessKey"] != "k":
                code = 403
            elif path == "/list/0.txt":
                code, body = 200, b"a%20b.pdf\n\nshaky.pdf\nnone.pdf\na b.pdf"
            elif path == "/shaky.pdf":
                code, body = (200, b"late") if n == 3 else (503, b"")
            elif path == "/down.pdf":
                code = 500
            elif path == "/a%20b.pdf":
                code, body = 200, b"body"
            elif path == "/last":
                code, body = 200, str(len(Store.jobs)).encode()
            elif path == "/jobs":
                code, body = 200, "\n".join(json.dumps({"number": i + 1, **Store.jobs[i]}) for i in range(int(bounds["after"]), int(bounds["upto"]))).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, Store
    server.shutdown()


def read(spark, base, **options):
    objects.register(spark)
    return spark.read.format("objects").options(base=base, accesskey="k", backoff="0.01", **options).load()


def test_objects_by_manifest_with_repeats_and_errors(spark, store):
    base, asked, _ = store
    df = read(spark, base, manifests='["list/0.txt"]', paths='["down.pdf", "a b.pdf"]', per_partition="1")
    assert df.rdd.getNumPartitions() == 3
    asked.clear()
    got = sorted((r.path, r.content and bytes(r.content), (r.error or "")[:14], r.attempts) for r in df.collect())
    assert got == [("a b.pdf", b"body", "", 1), ("a b.pdf", b"body", "", 1), ("a%20b.pdf", None, "HTTP Error 404", 1), ("down.pdf", None, "HTTP Error 500", 4), ("none.pdf", None, "HTTP Error 404", 1), ("shaky.pdf", b"late", "", 3)]
    assert read(spark, base, paths="[]").count() == 0


def test_a_manifest_that_is_missing_fails(spark, store):
    with pytest.raises(Exception, match="404"):
        read(spark, store[0], manifests='["list/none.txt"]').collect()


def test_queue_feeds_the_worker_and_goes_on_after_a_restart(spark, store, tmp_path):
    base, asked, store_class = store
    objects.register(spark)
    state = str(tmp_path / "state")

    def turn():
        told = spark.readStream.format("job_queue").options(base=base, accesskey="k", per_partition="2").load()
        events = told.select(F.from_json("job", JOBS).alias("j")).select("j.*")
        K.run(spark, events, state, work, F.lit(NOW).cast("timestamp")).awaitTermination()
        return {r.id: r.status for r in K.current(spark, state).collect()}

    store_class.jobs = [row(f"q{i}") for i in range(5)]
    assert turn() == {f"q{i}": J.COMPLETED for i in range(5)}
    asked.clear()
    store_class.jobs = [*store_class.jobs, row("q6", "bad"), row("q0")]
    assert turn()["q6"] == J.FAILED
    assert [p for p in asked if p.startswith("/jobs")] == ["/jobs?after=5&upto=7"]


def plain_batch(known, events, time):
    """The worker's rules by the book. known: id to (status, error, taken or ended, job); times are seconds of the day."""
    key = lambda e: (bool(e["completed"]), *[(v is not None, v if v is not None else 0) for v in (e["created"], e["filePath"], e["status"], e["completed"], e["updated"])])
    for i in {e["id"] for e in events}:
        mine = sorted((e for e in events if e["id"] == i), key=key)
        first, end = mine[0], next((e for e in mine if e["completed"]), None)
        if i in known and (known[i]["settled"] or end is None):
            continue
        job = dict(known.get(i, first))
        if end is not None:
            job |= {f: end[f] for f in ("status", "completed", "updated")}
        job["settled"] = bool(job["completed"]) or job["status"] == J.PENDING
        if job["settled"] and not job["completed"]:
            job |= {"status": J.FAILED, "error": "broken"} if "bad" in job["filePath"] else {"status": J.COMPLETED}
        known[i] = job
    for job in known.values():
        if not job["settled"] and job["status"] == J.PROCESSING and job["updated"] is not None and job["updated"] + 300 < time:
            job |= {"status": J.FAILED, "error": STUCK[1], "settled": True}


def test_batches_follow_the_rules_without_a_python_call_for_each_job(spark, tmp_path):
    r, known, events = random.Random(8), {}, []
    stamp = lambda s: s is not None and f"2024-01-01T{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}" or None
    (tmp_path / "in").mkdir()
    for n in range(3):
        time = 39_600 + 240 * n
        events = []
        for _ in range(250):
            status = r.choice([J.PENDING, J.PROCESSING, J.PROCESSING, "other", J.COMPLETED])
            events.append({"id": f"j{r.randrange(260)}", "filePath": r.choice(["x", "y", "bad"]), "status": status, "completed": r.choice([False, None]) if status != J.COMPLETED else True, "created": r.choice([None, 39_000, 39_100]), "updated": r.choice([None, time, time - 60, time - 299, time - 300, time - 301])})
        plain_batch(known, events, time)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({**e, "created": stamp(e["created"]), "updated": stamp(e["updated"])}) for e in events))
        told = spark.readStream.schema(JOBS).json(str(tmp_path / "in"))
        query = K.run(spark, told, str(tmp_path / "state"), work, F.lit(dt.datetime(2024, 1, 1, 11, 4 * n)).cast("timestamp"))
        query.awaitTermination()
        assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"stateStoreSave"}
        assert {x.id: (x.status, x.error) for x in K.current(spark, str(tmp_path / "state")).collect()} == {i: (j["status"], j.get("error")) for i, j in known.items()}
    held = spark.read.parquet(str(tmp_path / "state/open"))
    assert {x.batch for x in held.select("batch").collect()} == {1, 2}
    assert {x.id for x in held.filter("batch = 2 AND id IS NOT NULL").collect()} == {i for i, j in known.items() if not j["settled"]}
