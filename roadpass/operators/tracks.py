"""Car tracks and cars per monitor and five-minute range.

``points`` is the main form: one row per pass. The texts are renderings of it, one row per
car and day or per monitor and five minutes, for every car alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpass.functions import timekeys as K
from roadpass.operators.filters import for_cars
from roadpass.operators.skew import joined_text

RANGE_SECONDS = 300


def _entry(key: Column, clock: Column) -> Column:
    """``key=time``; a pass without id or readable time keeps its place in the list."""
    return F.concat(_text(key), F.lit("="), _text(K.clock_text(clock)))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _chosen(passes: DataFrame, cars: Sequence[str] | None) -> DataFrame:
    rows = for_cars(passes, cars) if cars else passes
    return rows.withColumn("clock", K.clock(F.col("ts")))


def _in_order(*fields: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def points(passes: DataFrame, cars: Sequence[str] | None = None) -> DataFrame:
    """(car, monitor_id, action_time, pass_id): the tracks as rows."""
    rows = for_cars(passes, cars) if cars else passes
    return rows.select("car", "monitor_id", "action_time", "pass_id")


def car_tracks(passes: DataFrame, cars: Sequence[str] | None = None) -> DataFrame:
    """(car, date, track) with track ``monitor=time|monitor=time`` of one day in time order."""
    lists = _chosen(passes, cars).groupBy("car", "date").agg(
        _in_order("clock", "pass_id", "monitor_id").alias("points")
    )
    text = joined_text("points", lambda p: _entry(p["monitor_id"], p["clock"]), "|")
    return lists.select("car", "date", text.alias("track"))


def monitor_tracks(passes: DataFrame) -> DataFrame:
    """(car, date, track) with track ``m1,m2,...`` of one day in time order."""
    lists = _chosen(passes, None).groupBy("car", "date").agg(
        _in_order("clock", "pass_id", "monitor_id").alias("points")
    )
    return lists.select(
        "car", "date", joined_text("points", lambda p: _text(p["monitor_id"]), ",").alias("track")
    )


def last_visits(passes: DataFrame) -> DataFrame:
    """(car, monitor_id, action_time): the latest pass of each car at each monitor."""
    rows = passes.groupBy("car", "monitor_id").agg(F.max("ts").alias("ts"))
    return rows.select("car", "monitor_id", K.time_text(F.col("ts")).alias("action_time"))


def range_cars(
    passes: DataFrame, last_visit_only: bool = True, cars: Sequence[str] | None = None
) -> DataFrame:
    """(monitor_id, range_time, cars) with cars ``car=time|car=time``.

    With ``last_visit_only`` a car counts once per monitor, at its latest pass there.
    """
    visits = _chosen(passes, cars).select("monitor_id", "car", "clock", "pass_id")
    tie = "pass_id"
    if last_visit_only:
        visits = visits.groupBy("monitor_id", "car").agg(F.max("clock").alias("clock"))
        tie = "car"
    return range_lists(visits, tie).drop("start")


def range_lists(visits: DataFrame, tie: str = "car") -> DataFrame:
    """(monitor_id, start, range_time, cars) of visits (car, monitor_id, clock)."""
    lists = (
        visits.withColumn("start", K.range_start(F.col("clock"), RANGE_SECONDS))
        .groupBy("monitor_id", "start")
        .agg(_in_order(*dict.fromkeys(("clock", tie, "car"))).alias("points"))
    )
    return lists.select(
        "monitor_id",
        "start",
        K.range_label(F.col("start"), RANGE_SECONDS).alias("range_time"),
        joined_text("points", lambda p: _entry(p["car"], p["clock"]), "|").alias("cars"),
    )
