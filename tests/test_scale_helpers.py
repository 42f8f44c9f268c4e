"""Salting at hot keys, checked broadcasts, companions, plate lookups, SQL functions, observed totals."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from roadpass.functions.sql import register
from roadpass.operators import companions, filters, monitors, skew
from roadpass.params import JobParams
from roadpass.plans import jobs
from roadpass.sinks import tables as sinks
from roadpass.sources import tables


def hot_rows(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i, f"c{i % 40}") for i in range(3000)]
    return spark.createDataFrame([*rows, (None, 1, "c1")], "k string, id bigint, car string").repartition(4)


def merged():
    return {
        "n": (F.count("*"), F.sum),
        "top": (F.max("id"), F.max),
        "cars": (F.collect_set("car"), lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))),
    }


@pytest.mark.parametrize("width", [4, 16, 4096])
def test_salted_aggregate_equals_the_plain_one_at_any_width(spark, width):
    df = hot_rows(spark)
    got = skew.salted_aggregate(df, ["k"], ["id"], merged(), target_rows=100, width=width)
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"), F.array_sort(F.collect_set("car")).alias("cars"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_only_hot_keys_are_salted(spark):
    df = hot_rows(spark)
    hot = skew.hot_keys(df, ["k"], target_rows=100)
    (key,) = df.where("k = 'hot'").select(F.xxhash64("k")).distinct().collect()
    assert hot == {key[0]: 10}
    assert skew.hot_keys(df.limit(0), ["k"]) == {}


def test_a_broken_bound_is_an_error(spark):
    df = spark.range(20).repartition(4)
    assert spark.range(30).join(skew.bounded_broadcast(df, 20), "id").count() == 20
    with pytest.raises(Exception, match="stated bound of 19"):
        spark.range(30).join(skew.bounded_broadcast(df, 19), "id").count()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_network_companions_equal_all_pairs(spark, make_passes, least):
    rng = random.Random(least)
    rows = [(f"c{rng.randrange(25)}", f"m{rng.randrange(4)}", f"2024-01-01 {rng.randrange(8):02d}:{rng.randrange(60):02d}:00") for _ in range(500)]
    # A jam that every car passes, and plates nobody could read.
    rows += [(f"c{i}", "m0", "2024-01-01 12:00:00") for i in range(25)]
    rows += [("unknown", f"m{i % 4}", f"2024-01-01 {i % 8:02d}:{i % 60:02d}:00") for i in range(100)] + [(None, "m1", "2024-01-01 12:00:00")]
    sets = {}
    for car, monitor, time in rows:
        if car not in (None, "unknown"):
            sets.setdefault(car, set()).add((monitor, time[:14] + f"{int(time[14:16]) // 5 * 5:02d}:00"))
    want = {}
    for a, b in combinations(sorted(sets), 2):
        both = sets[a] & sets[b]
        if len(both) >= least and len({m for m, _ in both}) >= 2:
            want[a, b] = (len(both), len({m for m, _ in both}), min(t for _, t in both), max(t for _, t in both))
    got = companions.network_companions(make_passes(rows), least)
    assert {(r.car, r.companion): tuple(r)[2:] for r in got.collect()} == want and want


def test_a_jam_forms_no_candidates(spark, make_passes):
    """Every car passes one jam and has two entries of its own."""
    rows = [(f"c{i:03d}", "m0", "2024-01-01 12:00:00") for i in range(200)]
    rows += [(f"c{i:03d}", f"m{1 + j}", f"2024-01-{2 + j:02d} {i // 10:02d}:{i % 10 * 5:02d}:00") for i in range(200) for j in range(2)]
    sets = make_passes(rows).selectExpr("car", "monitor_id", "unix_seconds(cast(ts as timestamp)) div 300 as slot").distinct()
    assert companions.candidate_pairs(sets, 1).count() == 200 * 199 // 2
    assert companions.candidate_pairs(sets, 2).count() == 0


def jammed(seed):
    rng = random.Random(seed)
    rows = [(f"c{rng.randrange(25)}", f"m{rng.randrange(4)}", f"2024-01-01 {rng.randrange(8):02d}:{rng.randrange(60):02d}:00") for _ in range(400)]
    return rows + [(f"c{i}", f"m{j}", f"2024-01-01 12:{j:02d}:00") for i in range(25) for j in range(3) if rng.random() < 0.8]


@pytest.mark.parametrize(("least", "crowd"), [(1, 1), (2, 1), (3, 10), (3, 1000)])
def test_network_companions_are_the_same_with_entries_held_back_and_in_passes(spark, make_passes, monkeypatch, least, crowd):
    passes = make_passes(jammed(least))
    want = sorted(map(tuple, companions.network_companions(passes, least).collect()))
    monkeypatch.setattr(companions, "PASS_PAIRS", 2000)
    monkeypatch.setattr(companions, "TASK_PAIRS", 500)
    entries = passes.selectExpr("car", "monitor_id", "unix_seconds(cast(ts as timestamp)) div 300 as slot").distinct()
    other = entries.toDF("other", "monitor_id", "slot")
    met = entries.join(other, ["monitor_id", "slot"]).where("car < other").groupBy("car", "other")
    met = met.agg(F.count("*").alias("n"), F.count_distinct("monitor_id").alias("m")).where(f"n >= {least} and m >= 2")
    got = companions.network_companions(passes, least, crowd=crowd).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(map(tuple, met.collect())) and got
    assert sorted(map(tuple, got)) == want


def test_companions_never_shuffle_or_store_pairs_that_meet_once(spark, make_passes):
    """200 cars meet in 19,900 pairs, none of which meets twice."""
    rows = [(f"c{i:03d}", "m0", "2024-01-01 12:00:00") for i in range(200)]
    rows += [(f"c{i:03d}", f"m{1 + i % 3}", f"2024-01-02 {i // 10:02d}:{i % 10 * 5:02d}:00") for i in range(200)]
    sets = make_passes(rows).selectExpr("car", "monitor_id", "unix_seconds(cast(ts as timestamp)) div 300 as slot").distinct()
    assert companions.candidate_pairs(sets, 2, crowd=1000).count() == 0


def test_unread_plates_are_counted(spark, make_passes):
    rows = make_passes([("a", "m", "2024-01-01 01:00:00"), (" ", "m", "2024-01-01 01:00:00"), (None, "m", "2024-01-02 01:00:00"), ("unknown", "m", "2024-01-02 01:00:00")])
    assert [r.car for r in filters.readable_plates(rows).collect()] == ["a"]
    assert sorted(map(tuple, filters.unread_passes(rows).collect())) == [("2024-01-01", 1), ("2024-01-02", 2)]


def rows_read(df):
    """Rows that the scan let through, after the plan has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_a_plate_lookup_skips_row_groups(spark, tmp_path):
    passes = tables.typed_passes(
        spark.range(40_000).selectExpr(
            "'2024-01-01' as date", "'m' as monitor_id", "'k' as camera_id", "concat('C', lpad(pmod(id * 7919, 20011), 6, '0')) as car",
            "'2024-01-01 10:00:00' as action_time", "'5' as speed", "'1' as road_id", "'00' as area_id",
        )
    )
    cars = ["C000017", "C009999", "C020001"]
    read = {}
    for by_car in (False, True):
        path = str(tmp_path / str(by_car))
        sinks.write_passes(passes.repartition(1) if not by_car else passes, path, by_car=by_car, group_bytes=64 << 10)
        found = filters.for_cars(tables.read_passes(spark, path), cars)
        assert found.count() == passes.where(F.col("car").isin(cars)).count() > 0
        read[by_car] = rows_read(found)
    assert read[True] * 2 < read[False]


def test_sql_functions_of_lists(spark):
    register(spark)
    row = spark.sql("SELECT counted_histogram(array(named_struct('value', 'b', 'n', 2L), named_struct('value', 'a', 'n', 1L), named_struct('value', 'b', 'n', 3L))) AS h").first()
    assert row.h == "a=1|b=5"
    assert [tuple(r) for r in spark.sql("SELECT * FROM prefix_rows('x,y,z')").collect()] == [("x", 1), ("x,y", 2), ("x,y,z", 3)]
    assert spark.sql("SELECT flow_level(171), flow_level(170), flow_level(151), flow_level(150)").first()[:] == ("A LEVEL", "B LEVEL", "C LEVEL", "D LEVEL")


def test_totals_are_gathered_while_rows_are_written(spark, make_passes, tmp_path):
    passes = make_passes([("a", "m1", "2024-01-01 01:00:00", {"camera": "1"}), ("b", "m2", "2024-01-01 01:00:00", {"camera": "1"})])
    registry = spark.createDataFrame([("m1", "1"), ("m2", "1"), ("m2", "2"), ("m3", "1")], "monitor_id string, camera_id string")
    params = JobParams(task_id=4, start_date="2024-01-01", end_date="2024-01-02")
    totals = jobs.write_monitor_state(passes, registry, params, str(tmp_path))
    want = monitors.network_state(monitors.monitor_status(registry, passes)).first().asDict()
    assert totals == want == {"normal_monitor_count": 1, "normal_camera_count": 2, "abnormal_monitor_count": 2, "abnormal_camera_count": 2}
    assert spark.read.parquet(f"{tmp_path}/network_state").drop("task_id").first().asDict() == want
    assert spark.read.parquet(f"{tmp_path}/monitor_status").count() == 3
    path = str(tmp_path / "passes")
    sinks.write_passes(passes, path)
    status, _ = monitors.observed_state(monitors.monitor_status(registry, tables.read_passes(spark, path)))
    assert status._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan") == 1
