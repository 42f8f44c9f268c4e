"""Sliding speed windows, incremental in the state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadpass.functions import timekeys as K
from roadpass.functions.classes import mean_speed
from roadpass.session import release, stored
from roadpass.sinks.keyed_log import KeyedLog
from roadpass.streaming.run import start, write_batch

CONGESTION_WINDOW = ("60 seconds", "10 seconds")
MINUTE_STORE_WINDOW = ("20 seconds", "10 seconds")


def _bound(side: str) -> Column:
    return K.clock_text(F.unix_seconds(F.col(f"window.{side}")))


def speed_windows(
    readings: DataFrame, length: str, slide: str, watermark: str = "1 minute"
) -> DataFrame:
    """(window_start, window_end, key, speed_sum, n) per sliding event-time window.

    Partial sums are combined before the shuffle and windows behind the watermark
    leave the state.
    """
    return (
        readings.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", length, slide), "key")
        .agg(F.sum(F.col("speed").cast("bigint")).alias("speed_sum"), F.count("*").alias("n"))
        .select(
            _bound("start").alias("window_start"), _bound("end").alias("window_end"), "key", "speed_sum", "n"
        )
    )


def congestion(readings: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """Cars, speed sum and mean speed per monitor, last 60 seconds every 10 seconds."""
    return speed_windows(readings, *CONGESTION_WINDOW, watermark).select(
        "window_start",
        "window_end",
        F.col("key").alias("monitor_id"),
        F.col("n").alias("car_count"),
        "speed_sum",
        mean_speed(F.col("speed_sum"), F.col("n")).alias("mean_speed"),
    )


def camera_windows(readings: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """Speed sum and count per camera, last 20 seconds every 10 seconds, keyed by the
    minute in which the window closes."""
    end = F.col("window_end")
    return speed_windows(readings, *MINUTE_STORE_WINDOW, watermark).select(
        K.day_key(end).alias("day"),
        K.minute_key(end).alias("hhmm"),
        F.col("key").alias("camera_id"),
        "window_end",
        "speed_sum",
        "n",
    )


PANE_SECONDS = 10
PANE_SCHEMA = "pane bigint, monitor_id string, speed_sum bigint, n bigint, batch_id bigint"


def congestion_panes(readings: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """(pane, monitor_id, speed_sum, n): ten-second panes, ``pane`` in seconds from 1970.

    A pass updates one row of the state, where the sliding window of a minute would update six.
    """
    length = f"{PANE_SECONDS} seconds"
    sums = (
        readings.withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", length), "key")
        .agg(F.sum(F.col("speed").cast("bigint")).alias("speed_sum"), F.count("*").alias("n"))
    )
    return sums.select(F.unix_seconds("window.start").alias("pane"), F.col("key").alias("monitor_id"), "speed_sum", "n")


def windows_of_panes(panes: DataFrame, length: int = 60) -> DataFrame:
    """The windows of ``congestion`` from panes, each pane a part of ``length`` / 10 windows."""
    starts = F.explode(F.sequence(F.col("pane") - length + PANE_SECONDS, F.col("pane"), F.lit(PANE_SECONDS).cast("bigint")))
    sums = (
        panes.select("monitor_id", "speed_sum", "n", starts.alias("start"))
        .groupBy("start", "monitor_id")
        .agg(F.sum("speed_sum").alias("speed_sum"), F.sum("n").alias("car_count"))
    )
    return sums.select(
        K.clock_text(F.col("start")).alias("window_start"),
        K.clock_text(F.col("start") + length).alias("window_end"),
        "monitor_id",
        "car_count",
        "speed_sum",
        mean_speed(F.col("speed_sum"), F.col("car_count")).alias("mean_speed"),
    )


def start_congestion_panes(
    readings: DataFrame, base: str, checkpoint: str, watermark: str = "1 minute", length: int = 60
) -> StreamingQuery:
    """Write the windows that each micro-batch changes, below ``base``/out, from panes kept in
    a log below ``base``/panes; read them back with ``run.latest`` as those of ``congestion``."""
    spark = readings.sparkSession
    log = KeyedLog(spark, f"{base}/panes", PANE_SCHEMA, ["pane", "monitor_id"], ["batch_id"])

    def add(batch: DataFrame, batch_id: int) -> None:
        changed = stored(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), "changed-panes")
        log.append(changed, "stream", batch_id)
        # A changed pane changes the windows that start up to length - 10 before it; they need
        # the panes of up to length - 10 on both sides.
        reach = length - PANE_SECONDS
        near = F.sequence(F.col("pane") - reach, F.col("pane") + reach, F.lit(PANE_SECONDS).cast("bigint"))
        needed = changed.select("monitor_id", F.explode(near).alias("pane")).distinct()
        touched = changed.select("monitor_id", F.explode(F.sequence(F.col("pane") - reach, F.col("pane"), F.lit(PANE_SECONDS).cast("bigint"))).alias("start"))
        named = touched.distinct().select("monitor_id", K.clock_text(F.col("start")).alias("window_start"))
        whole = windows_of_panes(log.read(only=needed), length)
        write_batch(f"{base}/out")(whole.join(named, ["monitor_id", "window_start"], "left_semi").select(*whole.columns), batch_id)
        log.compact()
        release(spark, changed.scratch_path)

    return start(congestion_panes(readings, watermark), add, checkpoint, "update", {"availableNow": True})
