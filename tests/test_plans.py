"""What the physical plans must and must not contain."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from roadpass import session
from roadpass.operators import filters, monitors, skew, speed
from roadpass.queries import REGISTERED
from roadpass.sinks import tables as sinks
from roadpass.sources import events, tables

SF_DIR = "/root/testdata/sf0.001"
EAGER = {name for name in REGISTERED if name.startswith(("stream_", "speed_class_", "job_", "task_")) or name.endswith("_trip")}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTERED) - EAGER))
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(REGISTERED[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
        assert operator not in text


def test_search_conditions_reach_the_scan(spark, tmp_path):
    sinks.write_passes(events.passes(spark, SF_DIR), str(tmp_path))
    found = filters.search(
        tables.read_passes(spark, str(tmp_path)),
        ranges={"speed": (60, 120)},
        any_of={"monitor_id": "0001,0003", "car": None},
        equal={"area_id": "03"},
    )
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    pushed = plan(found).split("PushedFilters")[1].split("ReadSchema")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(speed,60)" in pushed and "LessThanOrEqual(speed,120)" in pushed
    assert "In(monitor_id, [0001,0003])" in pushed and "EqualTo(area_id,03)" in pushed


def test_conversion_reads_the_passes_twice_at_most(spark):
    assert plan(REGISTERED["flow_conversion"](spark, SF_DIR)).count("FileScan") <= 2


def test_date_range_reaches_the_scan(spark):
    text = plan(events.passes(spark, SF_DIR, "2024-01-05", "2024-01-06").select("car"))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in text and "LessThan(ts,2024-01-07T00:00)" in text
    assert "event_id" not in text.split("ReadSchema")[1]


def test_scan_reads_only_needed_columns(spark):
    text = plan(monitors.busiest_monitors(events.passes(spark, SF_DIR), 3))
    assert "ReadSchema: struct<event_id:bigint>" in text and "TakeOrderedAndProject" in text


def test_roll_ups_use_hash_aggregation(spark):
    passes = events.passes(spark, SF_DIR)
    text = plan(passes.groupBy("monitor_id", "camera_id", "area_id").agg(F.count("*"), F.max("ts")))
    assert "SortAggregate" not in text
    assert "SortAggregate" not in plan(speed.speed_classes(passes))


def test_top_rows_are_limited_before_the_shuffle(spark):
    assert plan(speed.fastest_passes(events.passes(spark, SF_DIR))).count("WindowGroupLimit") == 2


def test_broadcast_needs_a_proven_bound(spark):
    big, small = spark.range(10), spark.range(10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound, expected in ((None, False), (skew.BROADCAST_ROWS + 1, False), (10, True)):
            joined = big.join(skew.bounded_broadcast(small, bound), "id")
            assert ("BroadcastHashJoin" in plan(joined)) is expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value


class _Session:
    def __init__(self, master, value):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = _Conf(value)


def test_scratch_folder_follows_the_cluster_setting():
    path = session.scratch_dir(_Session("yarn", "hdfs:///shared/"), "x")
    assert path.startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        session.scratch_dir(_Session("yarn", None), "x")
    assert session.scratch_dir(_Session("local[2]", None), "x") != session.scratch_dir(_Session("local[2]", None), "x")


def test_stored_frame_keeps_rows_and_schema(spark):
    df = spark.range(5).withColumn("t", F.lit("x"))
    kept = session.stored(df, "kept")
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.count() == 5
