"""Stratified sampling of cars by hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpass.functions.text import zero_pad
from roadpass.operators.skew import bounded_broadcast

# The draw of a car is a hash; its first hex digits name one of 16**3 draw buckets.
DRAW_DIGITS = 3
DEFAULT_SEED = 1000


def _hour_cars(passes: DataFrame) -> DataFrame:
    """Distinct (day, hour, car) from the pass time, days and hours still as numbers."""
    keys = passes.select(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"), "car")
    # Stated on the join keys: every branch of the sample then has the same filter and
    # they all read one shuffle of the distinct cars.
    return keys.where("day is not null and hour is not null").distinct()


def _with_day_totals(hours: DataFrame) -> DataFrame:
    """Add the cars of the day and the number of days; one row per hour, so few rows."""
    days = hours.agg(F.count_distinct("day")).scalar()
    return hours.select(
        "*", F.sum("hour_cars").over(Window.partitionBy("day")).alias("day_cars"), days.alias("days")
    )


def _quota(extract_num: int) -> Column:
    """Cars to draw from an hour: its share of the day's draw, rounded down."""
    per_day = F.floor(F.lit(extract_num) / F.col("days"))
    share = F.col("hour_cars").cast("double") / F.col("day_cars").cast("double")
    return F.least(F.floor(share * per_day).cast("bigint"), F.col("hour_cars"))


def _key_text() -> list[Column]:
    return [F.col("day").cast("string").alias("date"), zero_pad(F.col("hour")).alias("hour")]


def hour_quotas(passes: DataFrame, extract_num: int | None = None) -> DataFrame:
    """Cars per hour with the day total and, for a sample size, the hour's quota."""
    hours = _hour_cars(passes).groupBy("day", "hour").agg(F.count("*").alias("hour_cars"))
    hours = _with_day_totals(hours)
    quota = [_quota(extract_num).alias("quota")] if extract_num is not None else []
    return hours.select(*_key_text(), "hour_cars", "day_cars", *quota)


def untimed_passes(passes: DataFrame) -> DataFrame:
    """One row (untimed): passes without a readable time. They belong to no hour, so hour
    counts and samples leave them out, while tracks keep them."""
    return passes.agg(F.count_if(F.col("ts").isNull()).alias("untimed"))


def sample_cars(passes: DataFrame, extract_num: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """(date, hour, car): the cars with the smallest draws of each hour, quota many.

    Exact without ranking a whole hour in one task: counting cars per draw bucket
    shows which buckets the quota reaches, and only cars of those buckets are ranked,
    bucket by bucket.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *_key_text(), "car"))
    cars = _hour_cars(passes).withColumn("draw", draw)
    cars = cars.withColumn("bucket", F.substring("draw", 1, DRAW_DIGITS))
    buckets = cars.groupBy("day", "hour", "bucket").agg(F.count("*").alias("n"))
    hours = buckets.groupBy("day", "hour").agg(F.sum("n").alias("hour_cars"))
    quotas = _with_day_totals(hours).select("day", "hour", _quota(extract_num).alias("quota"))
    upto = Window.partitionBy("day", "hour").orderBy("bucket")
    reached = (
        buckets.join(quotas, ["day", "hour"])
        .withColumn("before", F.sum("n").over(upto) - F.col("n"))
        .where(F.col("before") < F.col("quota"))
        .select("day", "hour", "bucket", (F.col("quota") - F.col("before")).alias("room"))
    )
    rank = Window.partitionBy("day", "hour", "bucket").orderBy("draw", "car")
    return (
        cars.join(reached, ["day", "hour", "bucket"])
        .withColumn("rn", F.row_number().over(rank))
        .where(F.col("rn") <= F.col("room"))
        .select(*_key_text(), "car")
    )


def sampled_rows(sample: DataFrame) -> DataFrame:
    """Sample in output form: car, date, date_hour."""
    return sample.select("car", "date", F.concat("date", F.lit("_"), "hour").alias("date_hour"))


def sample_passes(
    passes: DataFrame, sample: DataFrame, extract_num: int, keep_multiplicity: bool = False
) -> DataFrame:
    """All passes of the sampled cars. With ``keep_multiplicity`` a car drawn in k hours
    repeats its passes k times. A sample never has more than ``extract_num`` rows."""
    if keep_multiplicity:
        return passes.join(bounded_broadcast(sample.select("car"), extract_num), "car")
    cars = bounded_broadcast(sample.select("car").distinct(), extract_num)
    return passes.join(cars, "car", "left_semi")
