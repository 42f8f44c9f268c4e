"""Job parameters, read from a task row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.functions.text import first_param


@dataclass(frozen=True)
class JobParams:
    task_id: int = 0
    start_date: str | None = None
    end_date: str | None = None
    top_num: int | None = None
    extract_num: int | None = None
    road_flow: tuple[str, ...] = ()
    cars: tuple[str, ...] = ()


# Field name -> key in the task's JSON parameter document (fixed values).
PARAM_KEYS = {
    "start_date": "startDate",
    "end_date": "endDate",
    "top_num": "topNum",
    "extract_num": "extractNum",
    "road_flow": "roadFlow",
    "cars": "cars",
}


def _split(text: str | None) -> tuple[str, ...]:
    return tuple(p.strip() for p in text.split(",")) if text else ()


def from_task(tasks: DataFrame, task_id: int) -> JobParams | None:
    """Parameters of one task, or None when the task does not exist.

    Only the selected row reaches the driver: a keyed lookup, filtered at the source.
    """
    row = (
        tasks.where(F.col("task_id") == task_id)
        .select(*[first_param(F.col("task_param"), key).alias(name) for name, key in PARAM_KEYS.items()])
        .first()
    )
    if row is None:
        return None
    return JobParams(
        task_id=task_id,
        start_date=row.start_date,
        end_date=row.end_date,
        top_num=int(row.top_num) if row.top_num is not None else None,
        extract_num=int(row.extract_num) if row.extract_num is not None else None,
        road_flow=_split(row.road_flow),
        cars=_split(row.cars),
    )
