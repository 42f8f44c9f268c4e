from __future__ import annotations

import pytest

from roadpass.operators import area, histogram, monitors, speed


@pytest.fixture(scope="module")
def network(spark, make_passes):
    """Monitor A complete, B with one unseen camera, C never observed, D not registered."""
    rows = [
        ("x", "A", "2024-01-01 08:00:00", {"camera": "1", "area": "00"}),
        ("x", "A", "2024-01-01 08:00:10", {"camera": "2", "area": "01"}),
        ("y", "A", "2024-01-01 08:00:05", {"camera": "2", "area": "02"}),
        ("y", "B", "2024-01-01 09:00:00", {"camera": "3"}),
        ("y", "B", "2024-01-01 09:00:00", {"camera": "9"}),
        ("z", "D", "2024-01-01 09:00:00", {"camera": "1"}),
    ]
    registry = [("A", "1"), ("A", "2"), ("A", "2"), ("B", "3"), ("B", "4"), ("C", "5"), ("C", "6")]
    return make_passes(rows), spark.createDataFrame(registry, "monitor_id string, camera_id string")


def test_rollup_takes_area_of_latest_pass(network):
    got = {r.monitor_id: r for r in monitors.monitor_rollup(network[0]).collect()}
    assert (got["A"].area_id, got["A"].camera_ids, got["A"].camera_count, got["A"].car_count) == (
        "01",
        "1,2",
        2,
        3,
    )


def test_registry_rollup_counts_rows(network):
    got = {r.monitor_id: (r.camera_ids, r.camera_count) for r in monitors.registry_rollup(network[1]).collect()}
    assert got == {"A": ("1,2,2", 3), "B": ("3,4", 2), "C": ("5,6", 2)}


def test_status(network):
    passes, registry = network
    got = {r.monitor_id: (r.status, r.unseen_cameras) for r in monitors.monitor_status(registry, passes).collect()}
    assert got == {"A": ("normal", ""), "B": ("abnormal", "4"), "C": ("missing", "5,6")}


def test_status_by_count_uses_counts_only(network):
    passes, registry = network
    status = monitors.monitor_status(registry, passes, mode="count")
    got = {r.monitor_id: r.status for r in status.collect()}
    # A has three registry rows for two cameras; B has two observed and two registered ones.
    assert got == {"A": "abnormal", "B": "normal", "C": "missing"}


def test_network_state(network):
    passes, registry = network
    status = monitors.monitor_status(registry, passes)
    row = monitors.network_state(status, infos=True).first()
    assert row.asDict() == {
        "normal_monitor_count": 1,
        "normal_camera_count": 3,
        "abnormal_monitor_count": 2,
        "abnormal_camera_count": 3,
        "abnormal_monitor_camera_infos": "B:4~C:5,6",
    }
    assert monitors.network_state(status, skip_missing=True).first().abnormal_monitor_count == 1
    assert "abnormal_monitor_camera_infos" not in monitors.network_state(status).columns
    total = row.normal_monitor_count + row.abnormal_monitor_count
    assert total == registry.select("monitor_id").distinct().count()


def test_unseen_cameras(network):
    got = {tuple(r) for r in monitors.unseen_cameras(network[1], network[0]).collect()}
    assert got == {("B", "4"), ("C", "5"), ("C", "6")}


def test_busiest_monitors_sorts_numbers(make_passes):
    rows = [("c", m, f"2024-01-01 08:{i // 60:02d}:{i % 60:02d}") for m, n in (("a", 9), ("b", 10), ("c", 100)) for i in range(n)]
    got = [(r.monitor_id, r.car_count) for r in monitors.busiest_monitors(make_passes(rows), 3).collect()]
    assert got == [("c", 100), ("b", 10), ("a", 9)]


def test_busiest_monitors_only_registered(network):
    passes, registry = network
    got = {r.monitor_id for r in monitors.busiest_monitors(passes, 9, registry).collect()}
    assert got == {"A", "B"}
    assert monitors.busiest_monitor_passes(passes, 1, registry).count() == 3


def test_speed_rank_and_fastest(make_passes):
    rows = [("a", "m1", f"2024-01-01 08:00:{i:02d}", {"speed": 100 + i}) for i in range(15)]
    rows += [("b", "m2", f"2024-01-01 08:00:{i:02d}", {"speed": 130}) for i in range(3)]
    rows += [("b", "m2", "2024-01-01 08:01:00", {"speed": "fast"}), ("b", "m3", "2024-01-01 08:01:00", {"speed": -1})]
    passes = make_passes(rows)
    ranked = [(r.monitor_id, r.high, r.medium, r.normal, r.low) for r in speed.speed_rank(passes).collect()]
    assert ranked == [("m2", 3, 0, 0, 0), ("m1", 0, 15, 0, 0), ("m3", 0, 0, 0, 0)]
    fastest = speed.fastest_passes(passes, limit=2).collect()
    by_monitor = {m: sorted((r.speed for r in fastest if r.monitor_id == m), reverse=True) for m in ("m1", "m2")}
    assert by_monitor == {"m1": list(range(114, 104, -1)), "m2": [130] * 3}


def test_unknown_area_is_dropped_and_salting_changes_nothing(spark, make_passes):
    rows = [("c", f"m{i % 3}", f"2024-01-01 08:00:{i:02d}", {"area": f"0{i % 2}", "road": "7"}) for i in range(40)]
    areas = spark.createDataFrame([(0, "North")], "id int, area_name string").selectExpr(
        "lpad(cast(id as string), 2, '0') as area_id", "area_name"
    )
    passes = make_passes(rows)
    plain = [tuple(r) for r in area.area_road_flow(passes, areas).collect()]
    assert plain == [("00", "7", 20, "m0=7|m1=6|m2=7")]
    assert [tuple(r) for r in area.area_road_flow(passes, areas, salts=4).collect()] == plain


def test_top_roads_keeps_three(spark):
    flow = spark.createDataFrame(
        [("a", str(i), n, "") for i, n in enumerate([171, 161, 151, 150, 150])],
        "area_id string, road_id string, car_count long, monitor_infos string",
    )
    got = sorted((r.road_id, r.flow_level) for r in area.top_roads(flow).collect())
    assert got == [("0", "A LEVEL"), ("1", "B LEVEL"), ("2", "C LEVEL")]


def test_histogram_accepts_values_and_partials(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a=2|b=3"), ("k", "|a=1"), ("j", "c")], "k string, v string")
    got = {r.k: (r.infos, r.n) for r in histogram.group_concat_counts(df, ["k"], "v", "infos", "n").collect()}
    assert got == {"k": ("a=3|b=4", 7), "j": ("c=1", 1)}
