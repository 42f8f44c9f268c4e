"""Speed classes, monitor ranking by them, and the fastest passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpass.functions.classes import SPEED_BANDS, in_band
from roadpass.operators.filters import at_monitors
from roadpass.operators.skew import bounded_broadcast

RANKED_MONITORS = 50
FASTEST_PER_MONITOR = 10


def speed_classes(passes: DataFrame) -> DataFrame:
    """Passes per speed band and monitor; negative or malformed speeds count nowhere."""
    return passes.groupBy("monitor_id").agg(
        *[F.count_if(in_band(F.col("speed"), band)).alias(band) for band, _, _ in SPEED_BANDS]
    )


def speed_rank(passes: DataFrame, limit: int = RANKED_MONITORS) -> DataFrame:
    """Monitors by fast vehicles: high, medium, normal, low counts, all descending."""
    return (
        speed_classes(passes)
        .orderBy(F.desc("high"), F.desc("medium"), F.desc("normal"), F.desc("low"), "monitor_id")
        .limit(limit)
    )


def fastest_passes(
    passes: DataFrame, limit: int = RANKED_MONITORS, per_monitor: int = FASTEST_PER_MONITOR
) -> DataFrame:
    """The fastest passes at each of the ranked monitors.

    Counting passes per speed gives the lowest speed that can still be among a
    monitor's fastest. Only passes from there up are ranked, so the pass table is read
    but never sorted. There is one such speed per ranked monitor, at most ``limit``.
    """
    rows = at_monitors(passes, speed_rank(passes, limit), max_rows=limit)
    rows = rows.where(F.col("speed").isNotNull())
    downward = Window.partitionBy("monitor_id").orderBy(F.desc("speed"))
    floors = (
        rows.groupBy("monitor_id", "speed")
        .agg(F.count("*").alias("n"))
        .withColumn("faster", F.sum("n").over(downward) - F.col("n"))
        .where(F.col("faster") < per_monitor)
        .groupBy("monitor_id")
        .agg(F.min("speed").alias("floor"))
    )
    best = Window.partitionBy("monitor_id").orderBy(
        F.desc("speed"), "action_time", "car", "camera_id", "pass_id"
    )
    fast = passes.join(bounded_broadcast(floors, limit), "monitor_id").where(F.col("speed") >= F.col("floor"))
    return (
        fast.drop("floor")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= per_monitor)
    )
