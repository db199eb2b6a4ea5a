"""The Spark session: settings for local runs, and how Python workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vellumine", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return prepare(builder.config(map=settings).getOrCreate())


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; of this machine only for a session that runs on it alone."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='vellumine-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch, where the session has Spark's default.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Lets the workers import this package also where it is not installed but only on the driver's path, and bounds what a worker is sent at once: 10,000
    long texts would be a batch of Spark's 64 MB."""
    if spark.conf.get(_BATCH) in ("64MB", "67108864b"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
