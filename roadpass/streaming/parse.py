"""Log lines to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass import schemas
from roadpass.functions import timekeys as K
from roadpass.functions.text import tab_fields, to_int
from roadpass.sources.tables import typed_passes


def parse_passes(lines: DataFrame) -> DataFrame:
    """Road log lines to typed passes, by the same rules as a log file."""
    return typed_passes(tab_fields(lines, schemas.PASS_LOG.names))


def parse_readings(
    lines: DataFrame, key_at: int, speed_at: int, time_at: int | None = None
) -> DataFrame:
    """(key, speed, event_time) from tab-separated lines of any layout.

    Without a time field the arrival time counts. Lines without key, speed or time
    carry no reading and are skipped.
    """
    last = max(key_at, speed_at, time_at or 0)
    fields = tab_fields(lines, [f"f{i}" for i in range(last + 1)])
    if time_at is None:
        event_time = F.current_timestamp()
    else:
        event_time = F.timestamp_seconds(K.text_clock(F.col(f"f{time_at}")))
    readings = fields.select(
        F.col(f"f{key_at}").alias("key"),
        to_int(F.col(f"f{speed_at}")).alias("speed"),
        event_time.alias("event_time"),
    )
    return readings.where("key is not null and speed is not null and event_time is not null")
