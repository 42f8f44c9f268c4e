"""Input and output schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Raw pass log: every field arrives as text.
PASS_LOG = _strings(
    "date", "monitor_id", "camera_id", "car", "action_time", "speed", "road_id", "area_id"
)
REGISTRY = _strings("monitor_id", "camera_id")
AREA = _strings("area_id", "area_name")
TASK = T.StructType(
    [T.StructField("task_id", T.LongType())]
    + list(
        _strings(
            "task_name",
            "create_time",
            "start_time",
            "finish_time",
            "task_type",
            "task_status",
            "task_param",
        )
    )
)

# The typed ``passes`` frame every operator works on.
PASSES = T.StructType(
    [
        *[T.StructField(n, T.IntegerType() if n == "speed" else T.StringType()) for n in PASS_LOG.names],
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("pass_id", T.LongType()),
    ]
)
# The minute store, partitioned by day. ``window_end`` and ``batch_id`` say which write a row
# came from, so a later one wins and a repeated one changes nothing.
MINUTE_SPEED = (
    "camera_id string, hhmm string, speed_sum bigint, n bigint, window_end string, batch_id bigint, day string"
)
MINUTE_KEYS = ("day", "camera_id", "hhmm")
DETAIL = ("date", "monitor_id", "camera_id", "car", "action_time", "speed", "road_id")

# Output tables, each led by the task that produced the rows.
OUTPUTS = {
    "topn_monitor_car_count": ("task_id", "monitor_id", "car_count"),
    "topn_monitor_detail_info": ("task_id", *DETAIL),
    "monitor_state": (
        "task_id",
        "normal_monitor_count",
        "normal_camera_count",
        "abnormal_monitor_count",
        "abnormal_camera_count",
        "abnormal_monitor_camera_infos",
    ),
    "monitor_status": (
        "task_id",
        "monitor_id",
        "camera_count",
        "observed_count",
        "car_count",
        "unseen_count",
        "unseen_cameras",
        "status",
    ),
    "network_state": (
        "task_id",
        "normal_monitor_count",
        "normal_camera_count",
        "abnormal_monitor_count",
        "abnormal_camera_count",
    ),
    "abnormal_camera": ("task_id", "monitor_id", "camera_id"),
    "top10_speed_detail": ("task_id", *DETAIL),
    "random_extract_car": ("task_id", "car", "date", "date_hour"),
    "random_extract_car_detail_info": ("task_id", *DETAIL),
    "car_track": ("task_id", "date", "car", "track"),
    "monitor_range_time_car": ("task_id", "monitor_id", "range_time", "cars"),
    "area_top3_road_flow": (
        "task_id",
        "area_id",
        "road_id",
        "car_count",
        "monitor_infos",
        "flow_level",
    ),
    "flow_conversion": ("task_id", "flow", "step", "match_count", "rate"),
}
