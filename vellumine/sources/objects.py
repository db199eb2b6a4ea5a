"""Data sources in Python: stored objects over HTTP (`objects`), and a numbered job queue as a stream (`job_queue`).

    register(spark)
    spark.read.format("objects").option("base", url).option("manifests", '["lists/0.txt", "lists/1.txt"]').load()
    spark.readStream.format("job_queue").option("base", url).load()

Options of both: base, accesskey and header (a key and the header that carries it), timeout (seconds), retries, backoff (seconds
before the first repeat; doubled each time).
"""

from __future__ import annotations

import http.client
import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Answers that a later try may better: time-outs, too many requests, and all from here on.
AGAIN, SERVER = {408, 425, 429}, 500
#: A batch on its way to Spark ends behind so many bytes or rows.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 256
_OBJECTS = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string()), ("attempts", pa.int32())])


class Http:
    """GET with repeats. A missing key sends none."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("base"):
            raise ValueError("option base must name where the objects are")
        self.base, self.key, self.header = options["base"].rstrip("/"), options.get("accesskey"), options.get("header", "AccessKey")
        self.timeout, self.retries, self.backoff = float(options.get("timeout", 120)), int(options.get("retries", 3)), float(options.get("backoff", 0.5))

    def get(self, path: str, query: str = "") -> tuple[bytes | None, str | None, int]:
        """(content, error, attempts); content or error is None."""
        asked = urllib.request.Request(f"{self.base}/{urllib.parse.quote(path.lstrip('/'))}{query}", headers={self.header: self.key} if self.key else {})
        attempt = 0
        while True:
            attempt += 1
            try:
                with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                    return answer.read(), None, attempt
            except urllib.error.HTTPError as e:
                said, hope = str(e), e.code in AGAIN or e.code >= SERVER
            except (OSError, http.client.HTTPException) as e:
                said, hope = f"{type(e).__name__}: {e}", not self.base.startswith("file:")
            if not hope or attempt > self.retries:
                return None, said, attempt
            time.sleep(self.backoff * 2 ** (attempt - 1) * random.uniform(0.5, 1.5))

    def text(self, path: str, query: str = "") -> str:
        content, error, _ = self.get(path, query)
        if content is None:
            raise OSError(f"{path}: {error}")
        return content.decode()


class Part(InputPartition):
    """Either a list of paths, or the name of an object that lists them, one a line."""

    def __init__(self, paths: list[str] | None = None, manifest: str | None = None) -> None:
        super().__init__((manifest, len(paths or [])))
        self.paths, self.manifest = paths, manifest


class Objects(DataSource):
    """path, content, error, attempts: a row for each object that is named, also for one that can't be had (its error says why).

    manifests: JSON list of objects that hold the paths, one a line; each is a partition and is read by its task, so that the driver
    never sees the paths. paths: JSON list of paths, for few; `per_partition` (64) make a partition. Empty lines are skipped, repeated
    paths are repeated rows. A manifest that can't be read fails its task: nothing is left out in silence."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "path string, content binary, error string, attempts int"

    def reader(self, schema: object) -> DataSourceReader:
        return ObjectReader(dict(self.options))


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.http = Http(options)
        self.paths, self.manifests = json.loads(options.get("paths", "[]")), json.loads(options.get("manifests", "[]"))
        self.size = max(1, int(options.get("per_partition", 64)))

    def partitions(self) -> list[Part]:
        few = [Part(self.paths[i : i + self.size]) for i in range(0, len(self.paths), self.size)]
        return [*[Part(manifest=m) for m in self.manifests], *few] or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        paths = part.paths if part.manifest is None else self.http.text(part.manifest).split("\n")
        rows, size = [], 0
        for path in paths:
            if not path:
                continue
            content, error, attempts = self.http.get(path)
            rows.append((path, content, error, attempts))
            size += len(content or b"")
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OBJECTS, strict=True)], schema=_OBJECTS)


class JobQueue(DataSource):
    """number, job (JSON text) of a queue that numbers its jobs from 1: GET base/last says the last number, GET base/jobs?after=A&upto=B
    gives those in between, one JSON object a line with its `number`. Offsets are numbers, so a restart goes on behind the last batch that
    was committed. Partitions: per_partition (1,000) numbers each. start: the number to begin behind, 0."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return "number bigint, job string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return QueueReader(dict(self.options))


class Numbers(InputPartition):
    def __init__(self, after: int, upto: int) -> None:
        super().__init__((after, upto))
        self.after, self.upto = after, upto


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.http, self.begin, self.size = Http(options), int(options.get("start", 0)), max(1, int(options.get("per_partition", 1000)))

    def initialOffset(self) -> dict:
        return {"number": self.begin}

    def latestOffset(self) -> dict:
        return {"number": max(self.begin, int(self.http.text("last")))}

    def partitions(self, start: dict, end: dict) -> list[Numbers]:
        first, last = start["number"], end["number"]
        return [Numbers(a, min(a + self.size, last)) for a in range(first, last, self.size)]

    def read(self, part: Numbers) -> Iterator[tuple]:
        for line in self.http.text("jobs", f"?after={part.after}&upto={part.upto}").split("\n"):
            if line:
                yield int(json.loads(line)["number"]), line


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Objects)
    spark.dataSource.register(JobQueue)
