"""Minute speed store: (day, camera_id, hhmm, speed_sum, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadpass.functions import timekeys as K
from roadpass.schemas import MINUTE_KEYS, MINUTE_SPEED
from roadpass.sinks.keyed_log import KeyedLog
from roadpass.streaming.run import latest, start

KEYS = MINUTE_KEYS


def minute_store(batches: DataFrame) -> DataFrame:
    """Collapse written camera windows: the last window closed in a minute wins, and of
    its repeated updates the newest."""
    rows = latest(batches, KEYS, newest=("window_end", "batch_id"))
    return rows.where(F.col("n") > 0).select(*KEYS, "speed_sum", "n")


def minute_log(spark: SparkSession, path: str) -> KeyedLog:
    """The store as a log: each micro-batch adds its own rows, ``read_minute_log`` merges."""
    return KeyedLog(spark, path, MINUTE_SPEED, KEYS, ["window_end", "batch_id"], partition=["day"])


def read_minute_log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(day, camera_id, hhmm, speed_sum, n) at a version of the log, the last one by default."""
    return minute_log(spark, path).read(version).select(*KEYS, "speed_sum", "n")


def add_windows(log: KeyedLog, batch: DataFrame, batch_id: int, writer: str = "stream") -> int:
    """Add the camera windows of a micro-batch; returns the version that holds them."""
    numbered = batch.where(F.col("n") > 0).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    return log.append(numbered.hint("rebalance", "day"), writer, batch_id)


def start_minute_store(
    windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Add the camera windows of every micro-batch to the log below ``path`` and merge its
    small deltas. A batch that is replayed after a failure changes nothing."""
    log = minute_log(windows.sparkSession, path)

    def add(batch: DataFrame, batch_id: int) -> None:
        add_windows(log, batch, batch_id)
        log.compact()

    return start(windows, add, checkpoint, "update", trigger or {"availableNow": True})


def minute_speed(passes: DataFrame) -> DataFrame:
    """The same table from a batch of passes: all passes of each camera and minute."""
    sums = (
        passes.where(F.col("speed").isNotNull() & F.col("ts").isNotNull())
        .groupBy("camera_id", F.floor(K.clock(F.col("ts")) / 60).alias("minute"))
        .agg(F.sum(F.col("speed").cast("bigint")).alias("speed_sum"), F.count("*").alias("n"))
    )
    time = K.clock_text(F.col("minute") * 60)
    return sums.select(
        K.day_key(time).alias("day"), "camera_id", K.minute_key(time).alias("hhmm"), "speed_sum", "n"
    )
