from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from roadpass import schemas
from roadpass.operators import filters
from roadpass.params import JobParams, from_task
from roadpass.plans import jobs
from roadpass.session import scratch_dir
from roadpass.sinks import tables as sinks
from roadpass.sources import tables
from roadpass.streaming import parse


@pytest.fixture(scope="module")
def log_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    rows = []
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        for i in range(40):
            hour = 23 + i % 2 if i > 30 else 8 + i % 3
            time = f"{day} {hour:02d}:{i:02d}:00"
            rows.append([day, f"000{i % 4}", f"{i % 4:05d}", f"car{i % 6}", time, str(i * 4), str(i % 2), f"0{i % 2}"])
    (folder / "log.txt").write_text("\n".join("\t".join(r) for r in rows) + "\n", encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def registry_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("registry") / "part-0.txt"
    path.write_text("\n".join(f"000{m}\t{m:05d}" for m in range(5)) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def passes(spark, log_dir):
    return tables.read_pass_log(spark, log_dir)


def test_log_is_typed(passes):
    assert passes.columns == schemas.PASSES.names
    assert [f.dataType for f in passes.schema] == [f.dataType for f in schemas.PASSES]
    assert passes.count() == 120 and passes.where("ts is null or speed is null").count() == 0
    # Hour 24 belongs to the next day.
    assert passes.where("substring(action_time, 1, 10) > date").count() == 15
    assert passes.select("pass_id").distinct().count() == 120


def test_catalog_source(spark, passes):
    raw = passes.select(*schemas.PASS_LOG.names).withColumn("speed", passes["speed"].cast("string"))
    raw.createOrReplaceTempView("monitor_flow_action")
    assert tables.read_catalog_passes(spark).count() == 120
    assert tables.read_catalog(spark, "monitor_flow_action").count() == 120


def test_date_filter_and_pushdown(spark, passes, tmp_path):
    assert filters.date_range(passes, "2024-01-01", "2024-01-02").count() == 80
    assert filters.date_range(passes, None, None).count() == 120
    path = str(tmp_path / "passes")
    sinks.write_passes(passes, path)
    with pytest.raises(ValueError, match="stored already"):
        sinks.write_passes(passes.where("date = '2024-01-02'"), path)
    sinks.write_passes(passes.where("date = '2024-01-02'"), path, replace=True)
    assert tables.read_passes(spark, path).count() == 120
    stored = filters.date_range(tables.read_passes(spark, path), "2024-01-02", "2024-01-02").select("car")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert stored.count() == 40 and "PartitionFilters: [isnotnull(date" in plan
    assert "ReadSchema: struct<car:string>" in plan


def test_late_passes_are_added_once(spark, passes, tmp_path):
    path = str(tmp_path / "late")
    sinks.write_passes(passes.where("speed > 40"), path)
    for _ in range(2):
        sinks.add_passes(passes.where("speed <= 80"), path)
    got = tables.read_passes(spark, path)
    assert got.count() == 120 and got.select("pass_id").distinct().count() == 120


def test_quote_marks_and_empty_fields(spark, tmp_path):
    line = '2024-01-01\t0001\t00001\t"A1\t2024-01-01 08:00:00\t50\t\t00'
    (tmp_path / "log.txt").write_text(line + "\n" + line.replace('"', "'") + "\nshort\n")
    batch = tables.read_pass_log(spark, str(tmp_path)).orderBy("car").collect()
    assert [(r.car, r.speed, r.road_id, r.area_id) for r in batch] == [
        (None, None, None, None), ('"A1', 50, "", "00"), ("'A1", 50, "", "00")
    ]
    stream = parse.parse_passes(spark.read.text(str(tmp_path))).orderBy("car").collect()
    assert stream == batch


def test_missing_parameters_are_named(passes):
    with pytest.raises(ValueError, match="top_num"):
        jobs.monitor_flow(passes, passes, JobParams(1))
    with pytest.raises(ValueError, match="extract_num"):
        jobs.random_extract(passes, JobParams(1))
    with pytest.raises(ValueError, match="road_flow"):
        jobs.flow_conversion(passes, JobParams(1))


def test_job_removes_its_scratch_folders(spark, passes, tmp_path):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    jobs.run_job(spark, lambda: jobs.random_extract(passes, JobParams(5, extract_num=10)), str(tmp_path), 5)
    assert set(os.listdir(shared)) == before
    assert spark.read.parquet(f"{tmp_path}/random_extract_car").count() > 0


def test_long_car_list_becomes_a_join(passes):
    cars = ["car1", "car2"] + [f"other{i}" for i in range(filters.IN_LIST_LIMIT)]
    assert filters.for_cars(passes, cars).count() == filters.for_cars(passes, ["car1", "car2"]).count() == 42


def test_search(passes):
    found = filters.search(
        passes,
        start="2024-01-01",
        end="2024-01-01",
        ranges={"speed": (40, 80), "road_id": (None, None)},
        any_of={"monitor_id": "0001,0002"},
        equal={"area_id": "01", "car": None},
    )
    assert {r.speed for r in found.collect()} == {i * 4 for i in range(10, 21) if i % 4 == 1}


def test_params_take_first_array_element(spark):
    text = '{"startDate":["2024-01-01"],"endDate":["2024-01-02"],"topNum":["3","9"],"roadFlow":["0001,0002"],"cars":[]}'
    row = (7, "n", None, None, None, "t", "s", text)
    tasks = spark.createDataFrame([row, (8, *row[1:7], "{}")], schemas.TASK)
    assert from_task(tasks, 7) == JobParams(7, "2024-01-01", "2024-01-02", 3, None, ("0001", "0002"), ())
    assert from_task(tasks, 8) == JobParams(8)
    assert from_task(tasks, 9) is None


def test_jdbc_options():
    assert tables.jdbc_options("jdbc:x", "area_info", user="u", partition=("id", 0, 100, 4)) == {
        "url": "jdbc:x",
        "dbtable": "area_info",
        "user": "u",
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": "100",
        "numPartitions": "4",
    }
    assert sinks.jdbc_write_options("jdbc:x", "t", batch_rows=50) == {
        "url": "jdbc:x",
        "dbtable": "t",
        "batchsize": "50",
    }


def test_all_jobs_write_their_tables(spark, passes, registry_path):
    params = JobParams(1, "2024-01-01", "2024-01-02", 2, 10, ("0000", "0001"), ("car1",))
    registry = tables.read_registry(spark, registry_path)
    areas = spark.createDataFrame([("00", "North"), ("01", "South")], schemas.AREA)
    base = scratch_dir(spark, "results")
    for results in (
        jobs.monitor_flow(passes, registry, params),
        jobs.random_extract(passes, params),
        jobs.area_top3(passes, areas, params),
        jobs.flow_conversion(passes, params),
    ):
        jobs.write_all(results, base, params.task_id)
    jobs.write_all(jobs.with_the_car(passes, params), base, 2)
    jobs.write_monitor_state(passes, registry, params, base)

    def read(table):
        return spark.read.parquet(f"{base}/{table}")

    assert read("topn_monitor_car_count").count() == 2
    assert read("topn_monitor_detail_info").count() == 40
    state = read("monitor_state").first()
    assert (state.normal_monitor_count, state.abnormal_monitor_count) == (4, 1)
    assert state.abnormal_monitor_camera_infos == "0004:00004"
    assert read("top10_speed_detail").count() == 40
    sampled = {r.car for r in read("random_extract_car").collect()}
    assert sampled and {r.car for r in read("random_extract_car_detail_info").collect()} == sampled
    assert {r.car for r in read("car_track").where("task_id = 1").collect()} == sampled
    own = read("car_track").where("task_id = 2").collect()
    assert sorted((r.car, str(r.date)) for r in own) == [("car1", "2024-01-01"), ("car1", "2024-01-02")]
    assert read("monitor_range_time_car").where("cars not like 'car1=%'").count() == 0
    assert read("area_top3_road_flow").count() == 2
    assert read("flow_conversion").count() == 2
    for table, columns in schemas.OUTPUTS.items():
        assert set(read(table).columns) == set(columns)


def test_rerun_replaces_only_its_own_task(spark):
    base = scratch_dir(spark, "rerun")
    df = spark.createDataFrame([("m1", 5), ("m2", 4)], "monitor_id string, car_count long")
    for task in (1, 2, 2):
        sinks.write_result(df, base, "topn_monitor_car_count", task)
    stored = spark.read.parquet(f"{base}/topn_monitor_car_count")
    assert {r.task_id: r["count"] for r in stored.groupBy("task_id").count().collect()} == {1: 2, 2: 2}
    sinks.write_result(df.limit(0), base, "topn_monitor_car_count", 2)
    left = spark.read.parquet(f"{base}/topn_monitor_car_count")
    assert {r.task_id for r in left.collect()} == {1}


def test_minute_store_and_predictions_replace_partitions(spark):
    base = scratch_dir(spark, "store")
    minutes = spark.createDataFrame(
        [("20240101", "k", "0800", 10, 2), ("20240102", "k", "0800", 10, 2)],
        "day string, camera_id string, hhmm string, speed_sum long, n long",
    )
    sinks.upsert_minute_speed(minutes, f"{base}/minutes")
    sinks.upsert_minute_speed(minutes.where("day = '20240102'").withColumn("n", minutes["n"] + 1), f"{base}/minutes")
    other = minutes.where("day = '20240102'").withColumn("hhmm", F.lit("0801"))
    sinks.upsert_minute_speed(other, f"{base}/minutes")
    assert tables.read_minute_speed(spark, f"{base}/minutes").count() == 3
    stored = tables.read_minute_speed(spark, f"{base}/minutes", "20240101", "20240102")
    got = {r.day: r.n for r in stored.where("hhmm = '0800'").collect()}
    assert got == {"20240101": 2, "20240102": 3}
    assert tables.read_minute_speed(spark, f"{base}/minutes", first_day="20240102").count() == 2
    scores = spark.createDataFrame(
        [("k", "20240101", "0800", 4.0)], "camera_id string, day string, hhmm string, prediction double"
    )
    sinks.write_predictions(scores, f"{base}/predictions")
    sinks.write_predictions(scores, f"{base}/predictions")
    assert spark.read.parquet(f"{base}/predictions").count() == 1
