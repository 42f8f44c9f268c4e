"""Passes, dimensions and streams derived from the benchmark tables.

The benchmark data has no checkpoint table, so each ``events`` row is read as one
pass: ids come from multiplicative hashes of the event and user ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass.functions import timekeys as K
from roadpass.functions.text import zero_pad

# The columns used of each benchmark table. Stating them saves the footer-reading job
# that schema inference would run for every query.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint",
    "region": "r_regionkey bigint",
    "supplier": "s_suppkey bigint",
}
# Number of distinct camera ids ``to_passes`` can produce.
CAMERAS = 60
# Longest list of ``camera_relations``.
RELATED = 7


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def plate(user_id: Column) -> Column:
    return F.concat(F.lit("C"), zero_pad(user_id, 5))


def _padded(number: Column, width: int) -> Column:
    """Zero padding for numbers known to fit."""
    return F.lpad(number.cast("string"), width, "0")


def to_passes(events: DataFrame) -> DataFrame:
    # Ids are reduced before multiplying, so large ids cannot overflow.
    event, user = F.col("event_id"), F.col("user_id")
    h1 = (event % 1000003) * F.lit(2654435761) % 1000003
    h2 = ((event % 999983) * 40503 + (user % 999983) * 7919) % 999983
    ts = F.col("ts")
    return events.select(
        K.date_text(ts).alias("date"),
        _padded(h1 % 9, 4).alias("monitor_id"),
        _padded(h2 % CAMERAS, 5).alias("camera_id"),
        plate(user).alias("car"),
        K.time_text(ts).alias("action_time"),
        (h2 % 260).cast("int").alias("speed"),
        ((h1 % 8) * (h2 % 7) + 1).cast("string").alias("road_id"),
        _padded((h1 + h2) % 8, 2).alias("area_id"),
        ts.alias("ts"),
        event.alias("pass_id"),
    )


def passes(
    spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Typed passes; an inclusive date range is pushed down to the scan as a range on ``ts``."""
    events = read(spark, sf_dir, "events")
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("ts") < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return to_passes(events)


LINE_FIELDS = ("date", "monitor_id", "camera_id", "car", "action_time", "speed", "road_id", "area_id")


def log_lines(rows: DataFrame) -> DataFrame:
    """Passes as tab-separated log lines."""
    return rows.select(F.concat_ws("\t", *LINE_FIELDS).alias("value"))


def pass_lines(spark: SparkSession, sf_dir: str, base: str, days: tuple[str, ...]) -> DataFrame:
    """The same passes as a stream of log lines that arrives in several files.

    The passes are written to the folder ``base``, as many files for each period between
    ``days`` as the stream reads at a time, oldest first: one micro-batch for each period.
    """
    rows = passes(spark, sf_dir)
    files = max(4, spark.sparkContext.defaultParallelism)
    starts, ends = (None, *days), (*days, None)
    for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
        part = rows if start is None else rows.where(F.col("date") >= start)
        part = part if end is None else part.where(F.col("date") < end)
        log_lines(part).repartition(files).write.text(f"{base}/part={k}")
    return (
        spark.readStream.schema("value string")
        .option("maxFilesPerTrigger", files)
        .text(f"{base}/part=*")
        .select("value")
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered cameras. Observed ones of monitor 0008 and with an id divisible by 7 are
    left out; five more at each of monitors 0000-0004 and an unused monitor 0009 are added."""
    seen = passes(spark, sf_dir).select("monitor_id", "camera_id").distinct()
    seen = seen.where((F.col("monitor_id") != "0008") & (F.col("camera_id").cast("int") % 7 != 0))
    extra = read(spark, sf_dir, "nation").select(
        zero_pad(F.col("n_regionkey"), 4).alias("monitor_id"),
        zero_pad(F.col("n_nationkey") + 60, 5).alias("camera_id"),
    )
    unused = read(spark, sf_dir, "region").select(
        F.lit("0009").alias("monitor_id"), zero_pad(F.col("r_regionkey"), 5).alias("camera_id")
    )
    return seen.union(extra).union(unused)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named areas; passes of area 05 have none."""
    return (
        read(spark, sf_dir, "nation")
        .where("n_nationkey <> 5")
        .select(zero_pad(F.col("n_nationkey"), 2).alias("area_id"), F.col("n_name").alias("area_name"))
    )


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plates of all suppliers."""
    return read(spark, sf_dir, "supplier").select(plate(F.col("s_suppkey")).alias("car"))


def camera_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of three to seven related cameras (ids wrap around). A camera stands in its own
    list at a position from 0 to 5, or not at all."""
    cameras = passes(spark, sf_dir).select("camera_id", F.col("camera_id").cast("bigint").alias("c")).distinct()
    last = F.pmod("c", F.lit(5)).cast("int") + 2
    placed = cameras.select("camera_id", "c", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    related = F.pmod(F.col("c") + F.col("pos") - F.pmod("c", F.lit(6)), F.lit(CAMERAS))
    return placed.select("camera_id", "pos", _padded(related, 5).alias("related_id"))
