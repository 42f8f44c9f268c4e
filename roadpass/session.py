"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_open_jobs: list[list[str]] = []

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "roadpass", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; the cluster's own values win
    wherever ``spark-submit`` already set them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Window state on local disk instead of the executors' heap.
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    For results that several later steps use: the work is done once, later plans know
    the real size, and a lost executor costs a re-read. ``scratch_path`` of the result names
    the folder, for ``release``.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is written or counted inside the block as soon as
    that is done, rather than when the driver forgets them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release(spark: SparkSession, *paths: str) -> None:
    """Remove scratch folders."""
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the scratch folders made inside the block and removes them at its end, so the
    job must have written its results by then."""
    _open_jobs.append([])
    try:
        yield
    finally:
        release(spark, *_open_jobs.pop())


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A machine-local folder is used only when the session runs in local mode and
    names no shared folder; on a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="roadpass-")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _open_jobs:
        _open_jobs[-1].append(path)
    return path
