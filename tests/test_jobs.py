import datetime as dt
import json

from pyspark.sql import functions as F

from vellumine.operators import jobs as J
from vellumine.sources import files, markup
from vellumine.streaming import jobs as stream

NOW = dt.datetime(2024, 1, 1, 12, 0)


def table(spark, *rows):
    return spark.createDataFrame([(i, 1, "f", p, s, s in ("completed", "failed"), c, u, None) for i, p, s, c, u in rows], stream.JOBS)


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


def test_claim_takes_the_oldest_then_the_least_id(spark):
    jobs = table(spark, ("b", "p", J.PENDING, at(-9), at(-9)), ("a", "p", J.PENDING, at(-9), at(-9)), ("c", "p", J.PROCESSING, at(-20), at(-1)))
    done = {r.id: r.status for r in J.claim(jobs, F.lit(NOW)).collect()}
    assert done == {"a": J.PROCESSING, "b": J.PENDING, "c": J.PROCESSING}


def test_expiry_is_strict(spark):
    jobs = table(spark, ("edge", "p", J.PROCESSING, NOW, at(-5)), ("old", "p", J.PROCESSING, NOW, at(-6)), ("new", "p", J.PENDING, NOW, at(-60)))
    done = {r.id: (r.status, r.completed) for r in J.expire_stuck(jobs, F.lit(NOW)).collect()}
    assert done == {"edge": (J.PROCESSING, False), "old": (J.FAILED, True), "new": (J.PENDING, False)}


def test_failure_cuts_the_error_and_completion_keeps_it(spark):
    jobs = table(spark, ("a", "p", J.PROCESSING, NOW, NOW))
    failed = J.mark_failed(jobs, F.lit(True), F.repeat(F.lit("x"), 20_000), F.lit(NOW))
    assert len(failed.first().error) == J.MOST_ERROR
    assert len(J.mark_completed(failed, F.lit(True), F.lit(NOW)).first().error) == J.MOST_ERROR


def test_upsert_overwrites_with_null_and_keeps_created(spark):
    old = spark.createDataFrame([(1, "d1", "x", at(-99), at(-99)), (2, "d2", "y", at(-99), at(-99))], "posterId long, doi string, domain string, created timestamp, updated timestamp")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "posterId long, domain string")
    got = {r.posterId: (r.doi, r.domain, r.created == NOW, r.updated == NOW) for r in J.upsert(old, new, "posterId", F.lit(NOW)).collect()}
    assert got == {1: ("d1", "x", False, False), 2: (None, "z", False, True), 3: (None, "w", True, True)}


def test_stream_equals_batch(spark, tmp_path):
    incoming, state = tmp_path / "in", tmp_path / "state"
    incoming.mkdir()

    def work(jobs):
        bad = F.col("filePath").contains("bad")
        return jobs.select("id", F.when(bad, "broken").alias("error"), F.upper("filePath").alias("title"))

    def put(name, *rows):
        (incoming / name).write_text("\n".join(json.dumps({"id": i, "posterId": 1, "filePath": p, "status": J.PENDING, "completed": False, "created": "2024-01-01T11:00:00", "updated": "2024-01-01T11:00:00"}) for i, p in rows))

    put("1.json", ("a", "x"), ("b", "bad"))
    stream.run(spark, str(incoming), str(state), work, F.lit(NOW)).awaitTermination()
    put("2.json", ("c", "y"), ("a", "again"), ("c", "zz"))
    stream.run(spark, str(incoming), str(state), work, F.lit(NOW)).awaitTermination()
    jobs = {r.id: (r.status, r.error) for r in spark.read.parquet(f"{state}/jobs/1").collect()}
    assert jobs == {"a": (J.COMPLETED, None), "b": (J.FAILED, "broken"), "c": (J.COMPLETED, None)}
    assert [r.title for r in spark.read.parquet(f"{state}/done/1").collect()] == ["Y"]
    put("3.json", ("d", "z"))
    stream.run(spark, str(incoming), str(state), work, F.lit(NOW)).awaitTermination()
    assert sorted(p.name for p in (state / "jobs").iterdir()) == ["1", "2"] and spark.read.parquet(f"{state}/jobs/2").count() == 4


def test_alto_with_and_without_name_space(spark):
    block = "<TextBlock><TextLine><String CONTENT='a'/><SP/><String ID=\"1\" CONTENT=\"b &amp; c\"/><String CONTENT=''/></TextLine></TextBlock><TextBlock/>"
    texts = [f'<alto xmlns="http://www.loc.gov/standards/alto/ns-v3#">{block}</alto>', f"<a:alto xmlns:a='urn:x'>{block.replace('<T', '<a:T').replace('</T', '</a:T').replace('<S', '<a:S')}</a:alto>", "no markup", "<alto><TextBlock><String CONTENT='caf&#233; &#x1F600; &amp;'/></TextBlock><TextBlock><String CONTENT=\"it's\"/></TextBlock></alto>", "<alto><TextBlock>", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    assert [r.t for r in rows.select("i", markup.alto_text(F.col("x")).alias("t")).orderBy("i").collect()] == ["a b & c", "a b & c", None, "café 😀 &\nit's", None, None]


def test_pairs_prefer_pdf(spark):
    paths = ["in/1/a.jpg", "in/1/a.pdf", "in/1/x_sub-json.json", "in/2/a.png", "in/3/b_sub-json.json", "in/4/a.jpeg", "in/4/c_sub-json.json"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [tuple(r) for r in files.annotation_pairs(rows).collect()] == [("1", "in/1/a.pdf", "in/1/x_sub-json.json")]


def test_extract_runs_tools_and_keeps_errors(spark):
    files.register("layout", lambda path, content: "short" if "s" in path else content.decode())
    files.register("plain", lambda path, content: "plain text")
    files.register("ocr", lambda path, content: 1 / 0)
    try:
        rows = spark.createDataFrame([("s.pdf", b"x"), ("l.pdf", b"y" * 501), ("i.png", b"z"), ("t.txt", b"")], "path string, content binary")
        got = {r.path: (len(r.text), r.source, r.error) for r in files.extract(rows).collect()}
    finally:
        files.EXTRACTORS.clear()
    assert got == {"s.pdf": (10, "plain", None), "l.pdf": (501, "layout", None), "i.png": (0, "ocr", "ocr: division by zero"), "t.txt": (0, "unknown", None)}


def test_settings_fall_through_when_empty(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("A_KEY='one'\n# B=2\n")
    monkeypatch.setenv("A_KEY", "")
    assert files.setting("A_KEY", "d", str(env)) == "one" and files.setting("B", "d", str(env)) == "d"


def test_download_gives_rows_for_errors(spark):
    import http.server
    import threading

    class Files(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.path == "/b/a%20b.pdf" and self.headers["AccessKey"] == "k"
            self.send_response(200 if good else 404)
            self.end_headers()
            self.wfile.write(b"body" if good else b"")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = spark.createDataFrame([("/a b.pdf",), ("none.pdf",)], "path string")
        got = {r.path: (r.content and bytes(r.content), r.error) for r in files.download(rows, f"http://127.0.0.1:{server.server_port}/b/", "k").collect()}
    finally:
        server.shutdown()
    assert got["/a b.pdf"] == (b"body", None) and got["none.pdf"][0] is None and "404" in got["none.pdf"][1]
