"""Classification and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Passes per (area, road) above which a level starts.
FLOW_LEVELS = ((170, "A LEVEL"), (160, "B LEVEL"), (150, "C LEVEL"))
LOWEST_FLOW_LEVEL = "D LEVEL"

# Half-open speed bands [from, to).
SPEED_BANDS = (("low", 0, 60), ("normal", 60, 90), ("medium", 90, 120), ("high", 120, None))

MAX_SPEED_CLASS = 10


def flow_level(car_count: Column) -> Column:
    out = None
    for floor, label in FLOW_LEVELS:
        cond = car_count > floor
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(LOWEST_FLOW_LEVEL)


def in_band(speed: Column, band: str) -> Column:
    _, lo, hi = next(b for b in SPEED_BANDS if b[0] == band)
    cond = speed >= lo
    return cond if hi is None else cond & (speed < hi)


def speed_class(mean_speed: Column) -> Column:
    """Class 0..10: tens of the mean speed, everything from 100 up is class 10."""
    return F.least(F.floor(F.floor(mean_speed) / 10), F.lit(MAX_SPEED_CLASS)).cast("double")


def mean_speed(speed_sum: Column, n: Column) -> Column:
    return F.try_divide(speed_sum.cast("double"), n)


def round_rate(value: Column, digits: int = 2) -> Column:
    """Half-up rounding."""
    return F.round(value, digits)
