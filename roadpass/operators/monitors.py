"""Monitor roll-ups, camera health and busiest monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from roadpass.operators.filters import at_monitors


def monitor_rollup(passes: DataFrame) -> DataFrame:
    """Per monitor: distinct cameras, their ids, passes, and the area of the latest pass
    (of several at the same instant, the highest area id).

    Passes are combined map-side with fixed-width buffers, so a busy monitor costs one
    row per camera, area and task in the shuffle, not one row per pass.
    """
    counts = passes.groupBy("monitor_id", "camera_id", "area_id").agg(
        F.count("*").alias("n"), F.max("ts").alias("ts")
    )
    cameras = F.array_sort(F.collect_set("camera_id"))
    return counts.groupBy("monitor_id").agg(
        F.max(F.struct("ts", "area_id"))["area_id"].alias("area_id"),
        F.array_join(cameras, ",").alias("camera_ids"),
        F.size(cameras).cast("bigint").alias("camera_count"),
        F.sum("n").alias("car_count"),
    )


def registry_rollup(registry: DataFrame) -> DataFrame:
    """Per monitor: registered cameras (not de-duplicated) and their ids."""
    return registry.groupBy("monitor_id").agg(
        F.array_join(F.sort_array(F.collect_list("camera_id")), ",").alias("camera_ids"),
        F.count("camera_id").alias("camera_count"),
    )


def unseen_cameras(registry: DataFrame, passes: DataFrame) -> DataFrame:
    """Registered cameras without a single pass."""
    seen = passes.select("monitor_id", "camera_id").distinct()
    return registry.distinct().join(seen, ["monitor_id", "camera_id"], "left_anti")


def monitor_status(registry: DataFrame, passes: DataFrame, mode: str = "cameras") -> DataFrame:
    """Health of every registered monitor.

    ``cameras``: normal when no registered camera is unseen. ``count``: normal when the
    number of observed cameras equals the number of registry rows. A monitor without
    any pass is ``missing`` in both. The passes are reduced to one row per observed
    camera before they meet the registry.
    """
    if mode not in ("cameras", "count"):
        raise ValueError(f"unknown mode: {mode}")
    seen = passes.groupBy("monitor_id", "camera_id").agg(F.count("*").alias("cars"))
    rows = registry if mode == "count" else registry.distinct()
    slots = rows.groupBy("monitor_id", "camera_id").agg(F.count("*").alias("slots"))
    # Full match keeps cameras that were observed but never registered.
    both = slots.join(seen, ["monitor_id", "camera_id"], "full")
    unseen = F.col("slots").isNotNull() & F.col("cars").isNull()
    per_monitor = both.groupBy("monitor_id").agg(
        F.coalesce(F.sum("slots"), F.lit(0)).alias("camera_count"),
        F.count("cars").alias("observed_count"),
        F.coalesce(F.sum("cars"), F.lit(0)).alias("car_count"),
        F.coalesce(F.sum(F.when(unseen, F.col("slots"))), F.lit(0)).alias("unseen_count"),
        F.array_join(F.sort_array(F.collect_list(F.when(unseen, F.col("camera_id")))), ",").alias(
            "unseen_cameras"
        ),
    )
    healthy = (
        F.col("unseen_count") == 0
        if mode == "cameras"
        else F.col("observed_count") == F.col("camera_count")
    )
    status = F.when(F.col("car_count") == 0, "missing").when(healthy, "normal").otherwise("abnormal")
    return per_monitor.where(F.col("camera_count") > 0).withColumn("status", status)


def network_state(status: DataFrame, skip_missing: bool = False, infos: bool = False) -> DataFrame:
    """One row of network totals; ``unseen_cameras`` has the abnormal cameras as rows.

    ``infos`` adds them as one text, for tables that want it. The text grows with the
    unseen part of the registry.
    """
    if skip_missing:
        status = status.where(F.col("status") != "missing")
    normal = F.col("status") == "normal"
    unseen = F.when(normal, F.lit(0)).otherwise(F.col("unseen_count"))
    entry = F.when(
        ~normal & (F.col("unseen_cameras") != ""),
        F.concat("monitor_id", F.lit(":"), "unseen_cameras"),
    )
    text = F.array_join(F.sort_array(F.collect_list(entry)), "~").alias("abnormal_monitor_camera_infos")
    return status.agg(
        F.count_if(normal).alias("normal_monitor_count"),
        F.coalesce(F.sum(F.col("camera_count") - unseen), F.lit(0)).alias("normal_camera_count"),
        F.count_if(~normal).alias("abnormal_monitor_count"),
        F.coalesce(F.sum(unseen), F.lit(0)).alias("abnormal_camera_count"),
        *([text] if infos else []),
    )


STATE_COUNTS = ("normal_monitor_count", "normal_camera_count", "abnormal_monitor_count", "abnormal_camera_count")


def observed_state(status: DataFrame, skip_missing: bool = False) -> tuple[DataFrame, Observation]:
    """The status rows, and the totals of ``network_state`` gathered while they are written.

    The totals are there once an action has run over the returned frame, so that writing the
    rows and summing them up is one pass over the data.
    """
    if skip_missing:
        status = status.where(F.col("status") != "missing")
    normal = F.col("status") == "normal"
    unseen = F.when(normal, F.lit(0)).otherwise(F.col("unseen_count"))
    values = (
        F.count_if(normal),
        F.coalesce(F.sum(F.col("camera_count") - unseen), F.lit(0)),
        F.count_if(~normal),
        F.coalesce(F.sum(unseen), F.lit(0)),
    )
    totals = Observation("network state")
    return status.observe(totals, *(v.alias(n) for n, v in zip(STATE_COUNTS, values, strict=True))), totals


def busiest_monitors(passes: DataFrame, top_num: int, registry: DataFrame | None = None) -> DataFrame:
    """The ``top_num`` monitors with most passes; with a registry, only registered ones."""
    counts = passes.groupBy("monitor_id").agg(F.count("*").alias("car_count"))
    if registry is not None:
        counts = counts.join(registry.select("monitor_id").distinct(), "monitor_id", "left_semi")
    return counts.orderBy(F.desc("car_count"), "monitor_id").limit(top_num)


def busiest_monitor_passes(
    passes: DataFrame, top_num: int, registry: DataFrame | None = None
) -> DataFrame:
    """All passes at the busiest monitors. The id list has at most ``top_num`` rows."""
    return at_monitors(passes, busiest_monitors(passes, top_num, registry), max_rows=top_num)
