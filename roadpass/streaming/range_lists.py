"""Cars per monitor and five minutes, kept up to date by increments.

A car counts once per monitor, at its latest pass there. The latest visit of each (car,
monitor) is stored; a later pass takes the car out of its old range and puts it into
its new one, and only these ranges are written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass.functions import timekeys as K
from roadpass.operators.tracks import RANGE_SECONDS, range_lists
from roadpass.session import release, stored
from roadpass.sinks.keyed_log import KeyedLog


class RangeLists:
    """Two logs below ``path``: the latest visits and the rendered ranges."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.visits = KeyedLog(
            spark, f"{path}/visits", "car string, monitor_id string, clock bigint", ["car", "monitor_id"], ["clock"]
        )
        self.ranges = KeyedLog(
            spark,
            f"{path}/ranges",
            "monitor_id string, start bigint, range_time string, cars string, batch_id bigint, gone boolean",
            ["monitor_id", "start"],
            ["batch_id"],
            gone="gone",
        )

    def add(self, passes: DataFrame, batch_id: int) -> None:
        """Take in passes. Batches come in order; a replay of the last one changes nothing.

        The visits are committed last, so a batch that stopped in between starts from the same
        visits again.
        """
        clock = K.clock(F.col("ts"))
        timed = passes.where(F.col("ts").isNotNull() & F.col("car").isNotNull() & F.col("monitor_id").isNotNull())
        new = timed.groupBy("car", "monitor_id").agg(F.max(clock).alias("clock"))
        old = self.visits.read(only=new).withColumnRenamed("clock", "was")
        later = F.col("was").isNull() | (F.col("clock") > F.col("was"))
        moved = stored(new.join(old, ["car", "monitor_id"], "left").where(later), "moved-visits")
        start = [K.range_start(F.col(c), RANGE_SECONDS) for c in ("clock", "was")]
        touched = moved.select("monitor_id", F.explode(F.array_compact(F.array(*start))).alias("start")).distinct()
        touched = stored(touched, "touched-ranges")
        after = self._visits_at(touched, moved.select("car", "monitor_id", "clock"))
        lists = touched.join(range_lists(after), ["monitor_id", "start"], "left")
        self.ranges.append(
            lists.select(
                "monitor_id",
                "start",
                "range_time",
                "cars",
                F.lit(batch_id).cast("bigint").alias("batch_id"),
                F.col("cars").isNull().alias("gone"),
            ),
            "ranges",
            batch_id,
        )
        self.visits.append(moved.select("car", "monitor_id", "clock"), "visits", batch_id)
        self.ranges.compact()
        self.visits.compact()
        release(self.spark, moved.scratch_path, touched.scratch_path)

    def _visits_at(self, touched: DataFrame, moved: DataFrame) -> DataFrame:
        """The visits that fall into the touched ranges once the moved ones are taken in."""

        def inside(rows: DataFrame) -> DataFrame:
            placed = rows.withColumn("start", K.range_start(F.col("clock"), RANGE_SECONDS))
            return placed.join(touched, ["monitor_id", "start"], "left_semi").drop("start")

        there = self.visits.read(only=inside(self.visits.rows()))
        stay = inside(there).join(moved, ["car", "monitor_id"], "left_anti")
        return stay.unionByName(moved, allowMissingColumns=True)

    def read(self, version: int | None = None) -> DataFrame:
        """(monitor_id, range_time, cars)"""
        return self.ranges.read(version).select("monitor_id", "range_time", "cars")
