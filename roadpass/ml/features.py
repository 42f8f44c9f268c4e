"""Feature rows: mean speeds of the related cameras in the minutes before.

A row belongs to (camera, minute). Its features are the mean speeds of the camera's
related cameras in the three minutes before, oldest minute first, related cameras in
list order; a minute without readings is -1. Its label is the camera's own mean
speed in the row's minute.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpass.functions import timekeys as K
from roadpass.functions.classes import mean_speed, speed_class
from roadpass.operators.skew import bounded_broadcast

LAGS = 3
MISSING = -1.0
WINDOW_HOURS = 6


def minute_means(minutes: DataFrame) -> DataFrame:
    """(camera_id, minute, v) with ``minute`` counted from 1970."""
    return minutes.where(F.col("n") > 0).select(
        "camera_id",
        K.minute_index(F.col("day"), F.col("hhmm")).alias("minute"),
        mean_speed(F.col("speed_sum"), F.col("n")).alias("v"),
    )


def relation_width(relations: DataFrame) -> int:
    """Number of positions the relations use: the largest one plus one."""
    return int(relations.agg(F.max("pos")).first()[0] or 0) + 1


def _checked(pos: Column, width: int) -> Column:
    """The position, or an error when it does not fit: no related camera is left out."""
    message = F.concat(F.lit(f"related camera at a position beyond width {width}: "), pos.cast("string"))
    return F.when(pos < width, pos).otherwise(F.raise_error(message).cast("int"))


def _related(means: DataFrame, relations: DataFrame, width: int, max_relations: int | None) -> DataFrame:
    """(camera_id, minute, pos, v, own): each stored minute handed to the cameras it informs.

    A camera's own reading comes with position NULL, whether or not the camera stands in
    its own list.
    """
    rel = relations.select(
        F.col("camera_id").alias("target"),
        _checked(F.col("pos"), width).alias("pos"),
        F.col("related_id").alias("camera_id"),
    )
    itself = relations.select("camera_id").distinct().select(
        F.col("camera_id").alias("target"), F.lit(None).cast("int").alias("pos"), "camera_id"
    )
    both = bounded_broadcast(rel.unionByName(itself), 2 * max_relations if max_relations else None)
    return means.join(both, "camera_id").select(
        F.col("target").alias("camera_id"),
        "minute",
        "pos",
        "v",
        F.when(F.col("pos").isNull(), F.col("v")).alias("own"),
    )


def _value_at(pos: int) -> Column:
    return F.coalesce(F.max(F.when(F.col("pos") == pos, F.col("v"))), F.lit(MISSING))


def _minutes_before(day: str, hhmm: str, minutes: int) -> tuple[str, str]:
    moment = datetime.strptime(day + hhmm, "%Y%m%d%H%M") - timedelta(minutes=minutes)
    return moment.strftime("%Y%m%d"), moment.strftime("%H%M")


def _keys(minute: Column) -> list[Column]:
    text = K.clock_text(minute * 60)
    return [K.day_key(text).alias("day"), K.minute_key(text).alias("hhmm")]


def training_rows(
    minutes: DataFrame,
    relations: DataFrame,
    width: int,
    until: tuple[str, str] | None = None,
    hours: int = WINDOW_HOURS,
    lags: int = LAGS,
    max_relations: int | None = None,
) -> DataFrame:
    """(camera_id, day, hhmm, features, label_speed, label) for every minute of a camera
    that has both related cameras and an own reading.

    ``until`` = (yyyyMMdd, HHmm) keeps the rows whose oldest feature minute lies in the
    last ``hours`` before it; by default the whole store is used. ``width`` is the number
    of positions in the relations (``relation_width``); a shorter list leaves the rest
    missing, a position beyond it is an error. ``max_relations`` is the proven row count
    of ``relations``, if there is one.
    """
    if until is not None:
        first_day, _ = _minutes_before(*until, minutes=hours * 60)
        last_day, _ = _minutes_before(*until, minutes=-lags)
        minutes = minutes.where(F.col("day").between(first_day, last_day))
    means = minute_means(minutes)
    if until is not None:
        end = K.minute_index(F.lit(until[0]), F.lit(until[1]))
        span = hours * 60
        means = means.where(F.col("minute").between(end - (span - lags), end - 1 + lags))
    # One shuffle by camera serves both the per-minute grouping and the frames below. A
    # camera has at most one row per minute, however many passes there are.
    informed = _related(means, relations, width, max_relations).repartition("camera_id")
    minute_rows = informed.groupBy("camera_id", "minute").agg(
        F.array(*[_value_at(p) for p in range(width)]).alias("values"),
        F.max("own").alias("label_speed"),
    )
    by_camera = Window.partitionBy("camera_id").orderBy("minute")
    missing = F.array_repeat(F.lit(MISSING), width)
    earlier = [
        F.coalesce(F.first("values").over(by_camera.rangeBetween(-lag, -lag)), missing)
        for lag in range(lags, 0, -1)
    ]
    rows = minute_rows.select("camera_id", "minute", "label_speed", F.concat(*earlier).alias("features"))
    rows = rows.where(F.col("label_speed").isNotNull())
    if until is not None:
        first = F.col("minute") - lags
        rows = rows.where(first.between(end - (span - lags), end - 1))
    return rows.select(
        "camera_id",
        *_keys(F.col("minute")),
        "features",
        "label_speed",
        speed_class(F.col("label_speed")).alias("label"),
    )


def rows_at(
    minutes: DataFrame,
    relations: DataFrame,
    day: str,
    hhmm: str,
    width: int,
    lags: int = LAGS,
    max_relations: int | None = None,
) -> DataFrame:
    """Feature rows of all cameras for predicting the minute after (day, hhmm)."""
    keys = [_minutes_before(day, hhmm, lag) for lag in range(lags - 1, -1, -1)]
    # Compared as stored keys, so the store is pruned to the day's partition.
    is_at = [(F.col("day") == d) & (F.col("hhmm") == m) for d, m in keys]
    lag_index = F.coalesce(*[F.when(cond, F.lit(i)) for i, cond in enumerate(is_at)])
    recent = minutes.where(reduce(or_, is_at) & (F.col("n") > 0))
    means = recent.select(
        "camera_id", lag_index.alias("minute"), mean_speed(F.col("speed_sum"), F.col("n")).alias("v")
    )
    rows = _related(means, relations, width, max_relations)
    slot = F.col("minute") * width + F.col("pos")
    values = [F.max(F.when(slot == i, F.col("v"))).alias(f"slot{i}") for i in range(lags * width)]
    known = rows.groupBy("camera_id").agg(*values)
    filled = [F.coalesce(f"slot{i}", F.lit(MISSING)) for i in range(lags * width)]
    cameras = relations.select("camera_id").distinct()
    return cameras.join(known, "camera_id", "left").select(
        "camera_id",
        F.lit(day).alias("day"),
        F.lit(hhmm).alias("hhmm"),
        F.array(*filled).alias("features"),
    )


def split(rows: DataFrame, train_share: float = 0.6, seed: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Random split decided by a hash of the row key: a recomputed partition puts every
    row on the same side again."""
    return tuple(rows.where(c) for c in split_conditions(train_share, seed))


def split_conditions(train_share: float, seed: int) -> tuple[Column, Column]:
    """Eight hex digits of the key's hash compared as text, which orders them as numbers."""
    draw = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "camera_id", "day", "hhmm")), 1, 8)
    train = draw < F.lit(f"{int(train_share * 2**32):08x}")
    return train, ~train
