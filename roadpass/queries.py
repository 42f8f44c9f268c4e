"""The registered queries: every operator over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass import params
from roadpass.functions import text as X
from roadpass.functions import timekeys as K
from roadpass.functions.sql import register
from roadpass.ml import camera_models, features, model
from roadpass.operators import (
    area,
    companions,
    filters,
    funnel,
    histogram,
    monitors,
    sampling,
    speed,
    tracks,
)
from roadpass.operators.skew import salted_aggregate
from roadpass.plans import jobs
from roadpass.schemas import DETAIL
from roadpass.session import scratch_dir, stored
from roadpass.sinks import tables as sinks
from roadpass.sources import events, tables
from roadpass.streaming import minute_store, parse, run, windows
from roadpass.streaming.range_lists import RangeLists

Query = Callable[[SparkSession, str], DataFrame]

TOP_NUM = 5
EXTRACT_NUM = 600
ROAD_FLOW = ("0001", "0004", "0000", "0004")
CARS = ("C00003", "C00007", "C00011")
FIRST_DAY, LAST_DAY = "2024-01-05", "2024-01-20"
SPEED_RANGE = (60, 120)
MONITORS = "0001,0003,0005"
CAMERAS = "00007,00021,00042"
AREA_ID = "03"
PREDICT_AT = ("20240115", "1230")
# Streams arrive in one file for each period between these days.
STREAM_DAYS = ("2024-01-08", "2024-01-15", "2024-01-23")
STATUS_DAY = "2024-01-07"
TASK_ID = 3

REGISTERED: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn


# Passes and filters


@query
def passes(spark, sf):
    return events.passes(spark, sf).drop("ts")


@query
def pass_count(spark, sf):
    return events.passes(spark, sf).agg(F.count("*").alias("pass_count"))


@query
def date_range_passes(spark, sf):
    rows = filters.date_range(events.passes(spark, sf, FIRST_DAY, LAST_DAY), FIRST_DAY, LAST_DAY)
    return rows.select("monitor_id", "car", "road_id", "area_id", "pass_id")


@query
def listed_car_passes(spark, sf):
    return filters.for_cars(events.passes(spark, sf), CARS).select(*DETAIL, "pass_id")


@query
def listed_cars_in_range(spark, sf):
    found = filters.cars_in_range(events.passes(spark, sf, FIRST_DAY, LAST_DAY), FIRST_DAY, LAST_DAY, CARS)
    return found.select(*DETAIL, "pass_id")


@query
def vehicle_search(spark, sf):
    found = filters.search(
        events.passes(spark, sf, FIRST_DAY, LAST_DAY),
        start=FIRST_DAY,
        end=LAST_DAY,
        ranges={"speed": SPEED_RANGE},
        any_of={"monitor_id": MONITORS, "car": None},
        equal={"area_id": AREA_ID, "road_id": None},
    )
    return found.select(*DETAIL, "area_id", "pass_id")


@query
def time_keys(spark, sf):
    time, second = F.col("action_time"), K.clock(F.col("ts"))
    start = K.range_start(second)
    return events.passes(spark, sf).select(
        "pass_id",
        K.date_hour(time).alias("date_hour"),
        K.range_label(start).alias("range_time"),
        K.day_key(time).alias("day"),
        K.minute_key(time).alias("hhmm"),
        K.seconds_between(time, K.clock_text(start)).alias("seconds_in_range"),
        K.is_before(time, F.concat("date", F.lit(" 12:00:00"))).alias("before_noon"),
        K.is_after(time, F.concat("date", F.lit(" 18:30:00"))).alias("evening"),
    )


@query
def prefixed_roads(spark, sf):
    named = X.concat_with(F.col("area_id"), F.col("road_id"), ":")
    salted = X.add_prefix(named, F.pmod("pass_id", F.lit(10)))
    return events.passes(spark, sf).select(
        "pass_id",
        salted.alias("salted"),
        X.drop_prefix(salted).alias("plain"),
        X.zero_pad(F.col("road_id")).alias("padded"),
    )


# Road flow per area


@query
def area_passes(spark, sf):
    named = area.with_area(events.passes(spark, sf), events.areas(spark, sf))
    return named.select("area_id", "area_name", "road_id", "monitor_id", "car", "pass_id")


@query
def area_road_flow(spark, sf):
    return area.area_road_flow(events.passes(spark, sf), events.areas(spark, sf))


@query
def area_top3(spark, sf):
    return area.top_roads(area.area_road_flow(events.passes(spark, sf), events.areas(spark, sf)))


@query
def salted_area_road(spark, sf):
    return area.area_road_flow(events.passes(spark, sf), events.areas(spark, sf), salts=10)


@query
def merged_histogram(spark, sf):
    """Partial histograms per day merged into one per area."""
    counts = histogram.value_counts(events.passes(spark, sf), ["area_id", "date"], "monitor_id")
    partial = histogram.render(counts, ["area_id", "date"], "monitor_id", "infos", "n")
    return histogram.group_concat_counts(partial, ["area_id"], "infos", "monitor_infos", "car_count")


@query
def sketch_salted_areas(spark, sf):
    """Counts, a maximum and a set of cars per area, salted where a sketch finds many rows."""
    merged = {
        "pass_count": (F.count("*"), F.sum),
        "max_speed": (F.max("speed"), F.max),
        "cars": (F.collect_set("car"), lambda name: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))), ",")),
    }
    return salted_aggregate(events.passes(spark, sf), ["area_id"], ["pass_id"], merged, target_rows=200)


AREA_TOP3_SQL = """
WITH counts AS (
  SELECT area_id, road_id, monitor_id, count(*) AS n FROM roadpass_passes GROUP BY area_id, road_id, monitor_id
),
roads AS (
  SELECT area_id, road_id, sum(n) AS car_count,
         counted_histogram(collect_list(named_struct('value', monitor_id, 'n', n))) AS monitor_infos
  FROM counts JOIN roadpass_areas USING (area_id) GROUP BY area_id, road_id
)
SELECT area_id, road_id, car_count, monitor_infos, flow_level(car_count) AS flow_level FROM (
  SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY car_count DESC, road_id) AS place FROM roads
) WHERE place <= 3
"""


@query
def area_top3_sql(spark, sf):
    """The busiest roads as one SQL text."""
    register(spark)
    events.passes(spark, sf).createOrReplaceTempView("roadpass_passes")
    events.areas(spark, sf).createOrReplaceTempView("roadpass_areas")
    return spark.sql(AREA_TOP3_SQL)


@query
def flow_prefixes_sql(spark, sf):
    """The beginnings of each task's monitor sequence, by a table function."""
    register(spark)
    found = F.get_json_object("task_param", "$.roadFlow[0]").alias("road_flow")
    _tasks(spark, sf).select("task_id", found).createOrReplaceTempView("roadpass_task_flows")
    return spark.sql("SELECT task_id, p.prefix AS flow, p.step FROM roadpass_task_flows, LATERAL prefix_rows(road_flow) p")


# Monitors


@query
def monitor_search(spark, sf):
    """Monitors that have one of the wanted cameras in their list of cameras."""
    found = filters.search(monitors.monitor_rollup(events.passes(spark, sf, FIRST_DAY, FIRST_DAY)), shared={"camera_ids": CAMERAS})
    return found.select("monitor_id", "camera_ids", "car_count")


@query
def monitor_rollup(spark, sf):
    return monitors.monitor_rollup(events.passes(spark, sf))


@query
def registry_rollup(spark, sf):
    return monitors.registry_rollup(events.registry(spark, sf))


@query
def monitor_status(spark, sf):
    return monitors.monitor_status(events.registry(spark, sf), events.passes(spark, sf))


def _day_passes(spark: SparkSession, sf: str) -> DataFrame:
    rows = events.passes(spark, sf, STATUS_DAY, STATUS_DAY)
    return filters.date_range(rows, STATUS_DAY, STATUS_DAY)


@query
def monitor_status_of_day(spark, sf):
    """One day only, so registered cameras without passes occur."""
    return monitors.monitor_status(events.registry(spark, sf), _day_passes(spark, sf))


@query
def abnormal_cameras_of_day(spark, sf):
    return monitors.unseen_cameras(events.registry(spark, sf), _day_passes(spark, sf))


@query
def monitor_status_by_count(spark, sf):
    return monitors.monitor_status(events.registry(spark, sf), events.passes(spark, sf), mode="count")


@query
def abnormal_cameras(spark, sf):
    return monitors.unseen_cameras(events.registry(spark, sf), events.passes(spark, sf))


@query
def network_state(spark, sf):
    return monitors.network_state(monitor_status(spark, sf), infos=True)


@query
def monitor_topn(spark, sf):
    return monitors.busiest_monitors(events.passes(spark, sf), TOP_NUM, events.registry(spark, sf))


@query
def monitor_topn_detail(spark, sf):
    rows = monitors.busiest_monitor_passes(events.passes(spark, sf), TOP_NUM, events.registry(spark, sf))
    return rows.select(*DETAIL, "pass_id")


@query
def speed_rank(spark, sf):
    return speed.speed_rank(events.passes(spark, sf))


@query
def speed_top10(spark, sf):
    return speed.fastest_passes(events.passes(spark, sf)).select(*DETAIL, "pass_id", "rank")


# Tracks, companions, conversion


@query
def flow_conversion(spark, sf):
    return funnel.conversion(events.passes(spark, sf), ROAD_FLOW)


@query
def car_track(spark, sf):
    return tracks.car_tracks(events.passes(spark, sf))


@query
def track_points(spark, sf):
    return tracks.points(events.passes(spark, sf))


@query
def last_visits(spark, sf):
    return tracks.last_visits(events.passes(spark, sf))


@query
def track_last_visits(spark, sf):
    """Last time per (car, monitor), read back from the rendered tracks of all days."""
    last = X.last_pairs(car_track(spark, sf), ["car"], "track", order=["date"])
    return last.select("car", F.col("k").alias("monitor_id"), F.col("v").alias("action_time"))


@query
def range_cars_last(spark, sf):
    return tracks.range_cars(events.passes(spark, sf))


@query
def range_cars_all(spark, sf):
    return tracks.range_cars(events.passes(spark, sf), last_visit_only=False)


def _suspects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CARS], "car string")


@query
def companions_of_watched(spark, sf):
    """Meetings of three suspect cars with every other car."""
    return companions.meetings(events.passes(spark, sf), _suspects(spark))


@query
def companion_passes(spark, sf):
    return companions.companions_of(events.passes(spark, sf), _suspects(spark))


@query
def companion_encounters(spark, sf):
    return companions.encounters(events.passes(spark, sf))


@query
def network_companions(spark, sf):
    """Pairs of cars with at least three common entries at two or more monitors."""
    return companions.network_companions(events.passes(spark, sf))


@query
def network_companions_twice(spark, sf):
    return companions.network_companions(events.passes(spark, sf), least=2, monitors=2)


def _with_unread(spark: SparkSession, sf: str) -> DataFrame:
    """Passes, every seventh of which lost its plate."""
    lost = F.col("pass_id") % 7 == 0
    text = F.when(F.col("pass_id") % 2 == 0, "unknown").when(F.col("pass_id") % 3 == 0, " ")
    return events.passes(spark, sf).withColumn("car", F.when(lost, text).otherwise(F.col("car")))


@query
def readable_car_track(spark, sf):
    return tracks.car_tracks(filters.readable_plates(_with_unread(spark, sf)))


@query
def unread_passes(spark, sf):
    return filters.unread_passes(_with_unread(spark, sf))


@query
def range_cars_incremental(spark, sf):
    """Range lists kept up to date over four increments, the last one repeated."""
    lists = RangeLists(spark, scratch_dir(spark, "range-lists"))
    rows = events.passes(spark, sf)
    starts, ends = (None, *STREAM_DAYS), (*STREAM_DAYS, None)
    # The third period comes after the fourth, so that passes arrive out of order too.
    for k, at in enumerate((0, 1, 3, 2, 2)):
        part = rows if starts[at] is None else rows.where(F.col("date") >= starts[at])
        part = part if ends[at] is None else part.where(F.col("date") < ends[at])
        lists.add(part, min(k, 3))
    return lists.read()


# Sampling


@query
def hour_counts(spark, sf):
    return sampling.hour_quotas(events.passes(spark, sf))


@query
def hour_quotas(spark, sf):
    return sampling.hour_quotas(events.passes(spark, sf), EXTRACT_NUM)


@query
def untimed_passes(spark, sf):
    return sampling.untimed_passes(events.passes(spark, sf))


@query
def hour_sample(spark, sf):
    return sampling.sampled_rows(sampling.sample_cars(events.passes(spark, sf), EXTRACT_NUM))


def _sampled_passes(spark: SparkSession, sf: str, keep_multiplicity: bool = False) -> DataFrame:
    rows = events.passes(spark, sf)
    sample = stored(sampling.sample_cars(rows, EXTRACT_NUM), "sample")
    return sampling.sample_passes(rows, sample, EXTRACT_NUM, keep_multiplicity)


@query
def hour_sample_detail(spark, sf):
    return _sampled_passes(spark, sf).select(*DETAIL, "pass_id")


@query
def hour_sample_detail_repeated(spark, sf):
    return _sampled_passes(spark, sf, keep_multiplicity=True).select(*DETAIL, "pass_id")


@query
def hour_sample_track(spark, sf):
    return tracks.monitor_tracks(_sampled_passes(spark, sf))


# Streams: the events table replayed as log lines, file by file, until it is used up


def _lines(spark: SparkSession, sf: str, base: str) -> DataFrame:
    return events.pass_lines(spark, sf, f"{base}/lines", STREAM_DAYS)


@query
def stream_congestion(spark, sf):
    base = scratch_dir(spark, "congestion")
    readings = parse.parse_readings(_lines(spark, sf, base), key_at=1, speed_at=5, time_at=4)
    stream = windows.congestion(readings)
    run.finish(run.start_updates(stream, f"{base}/out", f"{base}/checkpoint"))
    batches = run.read_batches(spark, f"{base}/out", stream.schema)
    return run.latest(batches, ["window_start", "window_end", "monitor_id"])


@query
def stream_congestion_panes(spark, sf):
    """The same windows, from ten-second panes."""
    base = scratch_dir(spark, "congestion-panes")
    readings = parse.parse_readings(_lines(spark, sf, base), key_at=1, speed_at=5, time_at=4)
    run.finish(windows.start_congestion_panes(readings, base, f"{base}/checkpoint"))
    schema = windows.congestion(readings).schema
    return run.latest(run.read_batches(spark, f"{base}/out", schema), ["window_start", "window_end", "monitor_id"])


@query
def stream_congestion_restarted(spark, sf):
    """The same windows by a query that is stopped between batches and started again."""
    base = scratch_dir(spark, "congestion-restarted")
    readings = parse.parse_readings(_lines(spark, sf, base), key_at=1, speed_at=5, time_at=4)
    stream = windows.congestion(readings)
    place = f"{base}/out", f"{base}/checkpoint"
    run.stop_after(run.start_updates(stream, *place, trigger={"processingTime": "0 seconds"}), 2)
    run.finish(run.start_updates(stream, *place))
    return run.latest(run.read_batches(spark, f"{base}/out", stream.schema), ["window_start", "window_end", "monitor_id"])


@query
def stream_minute_store(spark, sf):
    """Camera windows merged into the minute store batch by batch, and read back."""
    base = scratch_dir(spark, "minute-store")
    readings = parse.parse_readings(_lines(spark, sf, base), key_at=2, speed_at=5, time_at=4)
    stream = windows.camera_windows(readings)
    run.finish(minute_store.start_minute_store(stream, f"{base}/store", f"{base}/checkpoint"))
    return minute_store.read_minute_log(spark, f"{base}/store")


@query
def minute_log_versions(spark, sf):
    """The minute store as a log: three batches, a replay of the second, a merge of all
    deltas; rows of the last version and of the one before the third batch."""
    log = minute_store.minute_log(spark, scratch_dir(spark, "minute-log"))
    minutes = minute_speed(spark, sf).withColumn("window_end", F.concat("day", "hhmm"))
    late = F.col("hhmm") >= "1200"
    stale = minutes.where(late).withColumn("n", F.col("n") + 1)
    minute_store.add_windows(log, minutes.where(~late), 0)
    second = minute_store.add_windows(log, stale, 1)
    minute_store.add_windows(log, minutes.where(late), 2)
    minute_store.add_windows(log, stale, 1)
    log.compact(fan_in=3)
    keys = [*minute_store.KEYS, "speed_sum", "n"]
    now = log.read().select(*keys, F.lit("last").alias("at"))
    return now.unionByName(log.read(second).select(*keys, F.lit("second").alias("at")))


@query
def stream_watchlist(spark, sf):
    base = scratch_dir(spark, "watch-list")
    events.watch_list(spark, sf).write.text(f"{base}/list")
    stream = parse.parse_passes(_lines(spark, sf, base)).drop("ts", "pass_id")
    run.finish(run.start_watch_list(stream, f"{base}/list", f"{base}/out", f"{base}/checkpoint"))
    return run.read_batches(spark, f"{base}/out", stream.schema).drop("batch_id")


# Speed-class model


@query
def minute_speed(spark, sf):
    return minute_store.minute_speed(events.passes(spark, sf))


WIDTH = events.RELATED
MAX_RELATIONS = WIDTH * events.CAMERAS
FEATURES = features.LAGS * WIDTH


def _feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    relations = events.camera_relations(spark, sf)
    return features.training_rows(minute_speed(spark, sf), relations, WIDTH, max_relations=MAX_RELATIONS)


def _stored_features(spark: SparkSession, sf: str) -> DataFrame:
    """Training reads its rows many times, so they are computed once."""
    return stored(_feature_rows(spark, sf), "features")


@query
def minute_features(spark, sf):
    rows = _feature_rows(spark, sf)
    flat = [F.col("features")[i].alias(f"f{i}") for i in range(FEATURES)]
    return rows.select("camera_id", "day", "hhmm", *flat, "label_speed", "label")


@query
def feature_split(spark, sf):
    train, _ = features.split_conditions(0.6, 1000)
    side = F.when(train, "train").otherwise("test")
    return _feature_rows(spark, sf).select("camera_id", "day", "hhmm", side.alias("side"))


@query
def speed_class_model(spark, sf):
    """Test rows per label, all of them with a predicted class, and whether the acceptance
    decision accords with the precision measured on them."""
    rows = _stored_features(spark, sf)
    trained = model.train(rows, FEATURES)
    _, test = features.split(rows)
    scored = model.predict(trained.model, test)
    hits = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] or 0.0
    sound = abs(hits - trained.precision) < 1e-9 and trained.accepted == (hits > model.ACCEPTANCE)
    return scored.groupBy("label").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("prediction").between(0, 10)).alias("predicted"),
        F.lit(sound).alias("gate_sound"),
    )


@query
def speed_class_predictions(spark, sf):
    """Train, save, load, predict, store and read back. Random speeds cannot pass the real
    gate, so this path lets any model in."""
    base = scratch_dir(spark, "model")
    trained = model.train(_stored_features(spark, sf), FEATURES, acceptance=-1.0)
    model.save(spark, trained, base, "v1")
    relations = events.camera_relations(spark, sf)
    rows = features.rows_at(minute_speed(spark, sf), relations, *PREDICT_AT, WIDTH, max_relations=MAX_RELATIONS)
    sinks.write_predictions(model.predict(model.load(spark, base), rows), f"{base}/predictions")
    schema = "camera_id string, prediction double, day string, hhmm string"
    return (
        spark.read.schema(schema)
        .parquet(f"{base}/predictions")
        .select("camera_id", "day", "hhmm", F.col("prediction").between(0, 10).alias("valid"))
    )


PLANTED_CLASSES, NOISY = 2, 5


def _planted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows with a class that can be learnt from one of two features, which of them
    depends on the camera; every fifth camera's classes come from nowhere."""

    def drawn(word: str):
        digit = F.substring(F.md5(F.concat_ws("|", F.lit(word), "camera_id", "day", "hhmm")), 1, 1)
        return F.pmod(F.conv(digit, 16, 10).cast("int"), F.lit(PLANTED_CLASSES))

    camera = F.col("camera_id").cast("int")
    shown = F.pmod(drawn("plant") + camera, F.lit(PLANTED_CLASSES))
    label = F.when(camera % NOISY == 0, drawn("noise")).otherwise(drawn("plant"))
    marked = F.transform("features", lambda v, j: v / 10 + F.when(j == shown, 200.0).otherwise(0.0))
    rows = _feature_rows(spark, sf).withColumn("marked", marked)
    return rows.select("camera_id", "day", "hhmm", F.col("marked").alias("features"), label.cast("double").alias("label"))


@query
def camera_model_gates(spark, sf):
    """One model for each camera, trained at once: test rows and the gate; for accepted models
    the test rows classified right, and those of all rows by the models stored and loaded."""
    base = scratch_dir(spark, "camera-models")
    rows = stored(_planted_rows(spark, sf), "planted")
    trained = stored(camera_models.train_all(rows, FEATURES, PLANTED_CLASSES), "trained")
    camera_models.save_accepted(trained, base, "v1")
    loaded = camera_models.load_accepted(spark, base, "v1")
    scored = camera_models.predicted(loaded, rows, FEATURES, PLANTED_CLASSES).where("prediction is not null")
    right = scored.groupBy("camera_id").agg(F.count_if(F.col("prediction") == F.col("label")).alias("right"))
    hits = F.when(F.col("accepted"), F.col("hits")).alias("hits")
    return trained.join(right, "camera_id", "left").select("camera_id", "n_train", "n_test", hits, "accepted", "right")


# Sources and sinks: written, and read back


@query
def plate_lookup(spark, sf):
    """Three plates looked up in stored passes that are clustered by plate."""
    path = scratch_dir(spark, "plates")
    sinks.write_passes(events.passes(spark, sf), path, by_car=True)
    return filters.for_cars(tables.read_passes(spark, path), CARS).select(*DETAIL, "area_id", "pass_id")


@query
def pass_log_round_trip(spark, sf):
    """A text log with quote marks in plates and empty fields."""
    path = scratch_dir(spark, "log")
    rows = events.passes(spark, sf)
    odd = rows.withColumn("car", F.when(F.col("pass_id") % 3 == 0, F.concat(F.lit('"'), "car")).otherwise(F.col("car")))
    odd = odd.withColumn("road_id", F.when(F.col("pass_id") % 5 == 0, "").otherwise(F.col("road_id")))
    events.log_lines(odd).write.text(path)
    return tables.read_pass_log(spark, path).drop("ts", "pass_id")


@query
def registry_round_trip(spark, sf):
    path = scratch_dir(spark, "registry")
    events.registry(spark, sf).select(F.concat_ws("\t", "monitor_id", "camera_id").alias("value")).write.text(path)
    return tables.read_registry(spark, path)


@query
def catalog_round_trip(spark, sf):
    events.passes(spark, sf).select(*events.LINE_FIELDS, "pass_id").createOrReplaceTempView("roadpass_flow")
    return tables.read_catalog_passes(spark, "roadpass_flow").drop("ts")


@query
def pass_store_round_trip(spark, sf):
    """Two thirds of the passes stored, then all added, twice: nothing is lost or doubled."""
    path = scratch_dir(spark, "passes")
    rows = events.passes(spark, sf)
    sinks.write_passes(rows.where("pass_id % 3 > 0"), path)
    for _ in range(2):
        sinks.add_passes(rows, path)
    return tables.read_passes(spark, path).drop("ts")


@query
def minute_store_round_trip(spark, sf):
    """Minutes written in two halves, the second over a stale version of itself."""
    path = scratch_dir(spark, "minutes")
    minutes = minute_speed(spark, sf)
    late = F.col("hhmm") >= "1200"
    sinks.upsert_minute_speed(minutes.where(late).withColumn("n", F.col("n") + 1).withColumn("batch_id", F.lit(0)), path)
    sinks.upsert_minute_speed(minutes.where(~late), path)
    sinks.upsert_minute_speed(minutes.where(late), path)
    return tables.read_minute_speed(spark, path)


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    """A task for each nation, with its parameters as JSON."""
    key = F.col("n_nationkey")
    param = F.concat(
        F.lit('{"startDate":["' + FIRST_DAY + '"],"endDate":["' + LAST_DAY + '"],"topNum":["'),
        key.cast("string"),
        F.lit(f'"],"extractNum":["{EXTRACT_NUM}"],"roadFlow":["' + ",".join(ROAD_FLOW) + '"]}'),
    )
    return events.read(spark, sf, "nation").select(key.alias("task_id"), param.alias("task_param"))


@query
def task_parameters(spark, sf):
    found = params.from_task(_tasks(spark, sf), TASK_ID)
    return spark.createDataFrame(
        [(found.task_id, found.start_date, found.end_date, found.top_num, found.extract_num, ",".join(found.road_flow))],
        "task_id bigint, start_date string, end_date string, top_num int, extract_num int, road_flow string",
    )


def _job_tables(spark: SparkSession, sf: str, job: Callable, *table_names: str) -> list[DataFrame]:
    """A task's job run through its writer, and its tables read back."""
    found = params.from_task(_tasks(spark, sf), TASK_ID)
    base = scratch_dir(spark, "results")
    jobs.run_job(spark, lambda: job(events.passes(spark, sf), found), base, TASK_ID)
    return [spark.read.parquet(f"{base}/{t}") for t in table_names]


@query
def job_monitor_flow(spark, sf):
    def job(rows, found):
        return jobs.monitor_flow(rows, events.registry(spark, sf), found)

    top, state = _job_tables(spark, sf, job, "topn_monitor_car_count", "monitor_state")
    totals = state.select("task_id", "normal_monitor_count", "abnormal_monitor_count")
    return top.join(totals, "task_id").select(
        F.col("task_id").cast("bigint").alias("task_id"), "monitor_id", "car_count",
        "normal_monitor_count", "abnormal_monitor_count",
    )


@query
def job_monitor_state(spark, sf):
    """Status rows and totals, written in one pass over the task's passes and read back."""
    found = params.from_task(_tasks(spark, sf), TASK_ID)
    base = scratch_dir(spark, "results")
    jobs.write_monitor_state(events.passes(spark, sf), events.registry(spark, sf), found, base)
    status, state = (spark.read.parquet(f"{base}/{t}") for t in ("monitor_status", "network_state"))
    return status.drop("unseen_cameras").join(state, "task_id").withColumn("task_id", F.col("task_id").cast("bigint"))


@query
def job_topn_detail(spark, sf):
    def job(rows, found):
        return jobs.monitor_flow(rows, events.registry(spark, sf), found)

    (detail,) = _job_tables(spark, sf, job, "topn_monitor_detail_info")
    return _dated(detail).select(*DETAIL)


@query
def job_top10_speed(spark, sf):
    def job(rows, found):
        return jobs.monitor_flow(rows, events.registry(spark, sf), found)

    (detail,) = _job_tables(spark, sf, job, "top10_speed_detail")
    return _dated(detail).select(*DETAIL)


@query
def job_extract_detail(spark, sf):
    (detail,) = _job_tables(spark, sf, jobs.random_extract, "random_extract_car_detail_info")
    return _dated(detail).select(*DETAIL)


@query
def job_range_cars(spark, sf):
    (found,) = _job_tables(spark, sf, jobs.with_the_car, "monitor_range_time_car")
    return found.select("monitor_id", "range_time", "cars")


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", F.col("date").cast("string"))


@query
def job_random_extract(spark, sf):
    (cars,) = _job_tables(spark, sf, jobs.random_extract, "random_extract_car")
    return cars.select("car", "date", "date_hour")


@query
def job_with_the_car(spark, sf):
    (found,) = _job_tables(spark, sf, jobs.with_the_car, "car_track")
    return found.select("car", F.col("date").cast("string").alias("date"), "track")


@query
def job_area_top3(spark, sf):
    def job(rows, found):
        return jobs.area_top3(rows, events.areas(spark, sf), found)

    (found,) = _job_tables(spark, sf, job, "area_top3_road_flow")
    return found.select("area_id", "road_id", "car_count", "flow_level")


@query
def job_flow_conversion(spark, sf):
    (found,) = _job_tables(spark, sf, jobs.flow_conversion, "flow_conversion")
    return found.select("flow", "step", "match_count", "rate")
