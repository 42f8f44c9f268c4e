"""The batch jobs. Each returns its result tables as DataFrames by table name; only
``random_extract`` writes its sample when it is called, since its tables share it.
``run_job`` runs a job, writes its tables and removes its scratch folders.

The pass table is never cached: every result reads only its own columns of the
requested dates, which costs less than holding the whole period in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from roadpass.operators import area, filters, funnel, monitors, sampling, speed, tracks
from roadpass.params import JobParams
from roadpass.session import job_scratch, stored
from roadpass.sinks.tables import write_result


def _passes(passes: DataFrame, params: JobParams) -> DataFrame:
    return filters.date_range(passes, params.start_date, params.end_date)


def _require(params: JobParams, name: str) -> None:
    if not getattr(params, name):
        raise ValueError(f"task {params.task_id} needs the parameter {name}")


def monitor_flow(passes: DataFrame, registry: DataFrame, params: JobParams) -> dict[str, DataFrame]:
    """Camera health, busiest monitors with their passes, fastest passes."""
    _require(params, "top_num")
    rows = _passes(passes, params)
    return {
        "monitor_state": monitors.network_state(monitors.monitor_status(registry, rows), infos=True),
        "abnormal_camera": monitors.unseen_cameras(registry, rows),
        "topn_monitor_car_count": monitors.busiest_monitors(rows, params.top_num, registry),
        "topn_monitor_detail_info": monitors.busiest_monitor_passes(rows, params.top_num, registry),
        "top10_speed_detail": speed.fastest_passes(rows),
    }


def random_extract(passes: DataFrame, params: JobParams) -> dict[str, DataFrame]:
    """Stratified car sample, the sampled cars' passes and tracks."""
    _require(params, "extract_num")
    rows = _passes(passes, params)
    sample = stored(sampling.sample_cars(rows, params.extract_num), "sample")
    detail = sampling.sample_passes(rows, sample, params.extract_num)
    return {
        "random_extract_car": sampling.sampled_rows(sample),
        "random_extract_car_detail_info": detail,
        "car_track": tracks.monitor_tracks(detail),
    }


def with_the_car(passes: DataFrame, params: JobParams) -> dict[str, DataFrame]:
    """Tracks and cars per monitor and five-minute range, of all or of the listed cars."""
    rows = _passes(passes, params)
    return {
        "car_track": tracks.car_tracks(rows, params.cars),
        "monitor_range_time_car": tracks.range_cars(rows, cars=params.cars),
    }


def area_top3(passes: DataFrame, areas: DataFrame, params: JobParams) -> dict[str, DataFrame]:
    """Busiest roads per area."""
    flow = area.area_road_flow(_passes(passes, params), areas)
    return {"area_top3_road_flow": area.top_roads(flow)}


def flow_conversion(passes: DataFrame, params: JobParams) -> dict[str, DataFrame]:
    """Conversion along the task's monitor sequence."""
    _require(params, "road_flow")
    return {"flow_conversion": funnel.conversion(_passes(passes, params), params.road_flow)}


def write_all(results: Mapping[str, DataFrame], base: str, task_id: int) -> None:
    for table, df in results.items():
        write_result(df, base, table, task_id)


def run_job(spark: SparkSession, job: Callable[[], Mapping[str, DataFrame]], base: str, task_id: int) -> None:
    """Run ``job``, write its tables and remove what it kept in the scratch folder."""
    with job_scratch(spark):
        write_all(job(), base, task_id)


def write_monitor_state(
    passes: DataFrame, registry: DataFrame, params: JobParams, base: str, skip_missing: bool = False
) -> dict[str, int]:
    """Write the status of every monitor and the network's totals, reading the passes once.

    Tables ``monitor_status`` and ``network_state``. The unseen cameras are named in their
    monitor's row, so no row grows with the registry. Returns the totals.
    """
    status = monitors.monitor_status(registry, _passes(passes, params))
    rows, totals = monitors.observed_state(status, skip_missing)
    write_result(rows, base, "monitor_status", params.task_id)
    found = totals.get
    state = passes.sparkSession.createDataFrame([found], ", ".join(f"{n} bigint" for n in monitors.STATE_COUNTS))
    write_result(state, base, "network_state", params.task_id)
    return found
