"""Spark session defaults and the shared work folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "ticketflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the clock of a session built elsewhere, as every timestamp here is UTC, and ship this package to its workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they start: once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="ticketflow-package-"), "ticketflow.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is absent and all tasks run in this process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="ticketflow-")
    return _local_dirs[sc.applicationId]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table or one streaming checkpoint."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ticketflow/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> bool:
    """Delete the work tables of this application, once none of its results is needed any more."""
    return release_path(spark, _own_dir(spark))


def release_path(spark: SparkSession, path: str) -> bool:
    """Delete one work table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def give_back(spark: SparkSession) -> None:
    """Delete shuffle files that no DataFrame at hand needs now, not when the driver happens to collect its garbage. What
    the present call was given is still at hand, so it is the next call that frees its shuffles."""
    for _ in range(2):  # plans go with the first round, and what only they held with the second
        gc.collect()
        time.sleep(0.3)  # Python lets go of what it held in the JVM a little later
        spark.sparkContext._jvm.System.gc()


def stage_at(df, name: str):
    """As ``stage``, with the path for ``release_path``."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df, name: str):
    """Write ``df`` below the shared folder and read it back.

    Cuts the lineage, so that costly expressions run once and lost executors re-read files instead of
    repeating shuffles.
    """
    return stage_at(df, name)[0]
