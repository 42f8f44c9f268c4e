from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from roadpass.session import ROCKSDB_PROVIDER, scratch_dir
from roadpass.sinks import tables as sinks
from roadpass.sources import tables
from roadpass.sources.streams import StreamSpec, kafka_options, read_lines
from roadpass.streaming import minute_store, parse, run, windows

START = datetime(2024, 3, 10, 1, 59)


def line(car, monitor, camera, seconds, speed):
    time = (START + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")
    return "\t".join([time[:10], monitor, camera, car, time, str(speed), "1", "00"])


@pytest.fixture
def feed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    count = iter(range(1000))

    def add(lines):
        (folder / f"{next(count):04d}.txt").write_text("\n".join(lines) + "\n")

    return str(folder), add


def lines_of(n, seed=1):
    rng = random.Random(seed)
    return [
        line(f"c{rng.randrange(5)}", f"m{rng.randrange(2)}", f"k{rng.randrange(3)}", rng.randrange(600), rng.randrange(200))
        for _ in range(n)
    ]


def readings(spark, folder, key_at):
    spec = StreamSpec("text", path=folder, options={"maxFilesPerTrigger": "1"})
    return parse.parse_readings(read_lines(spark, spec), key_at=key_at, speed_at=5, time_at=4)


def finish(spark, start, stream, base=None):
    base = base or scratch_dir(spark, "test")
    start(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return run.read_batches(spark, f"{base}/out", stream.schema)


def expected(all_lines, key_at, length, slide=10):
    sums = {}
    for text in all_lines:
        f = text.split("\t")
        second = int((datetime.fromisoformat(f[4]) - START).total_seconds())
        first = second - second % slide
        for start in range(first, second - length, -slide):
            key = (start, f[key_at])
            s, n = sums.get(key, (0, 0))
            sums[key] = (s + int(f[5]), n + 1)
    return sums


def stamp(seconds):
    return (START + timedelta(seconds=seconds)).strftime("%Y-%m-%d %H:%M:%S")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(params=["default", "rocksdb"])
def state_store(spark, request):
    before = spark.conf.get(PROVIDER)
    if request.param == "rocksdb":
        spark.conf.set(PROVIDER, ROCKSDB_PROVIDER)
    yield request.param
    spark.conf.set(PROVIDER, before)


def test_congestion_equals_batch_over_several_batches(spark, feed, state_store):
    folder, add = feed
    everything = lines_of(120)
    for i in range(3):
        add(everything[i::3])
    # The files interleave in time, so no row may be late: allow the whole span.
    stream = windows.congestion(readings(spark, folder, 1), watermark="20 minutes")
    batches = finish(spark, run.start_updates, stream)
    assert batches.select("batch_id").distinct().count() == 3
    got = {
        (r.window_start, r.window_end, r.monitor_id): (r.speed_sum, r.car_count, r.mean_speed)
        for r in run.latest(batches, ["window_start", "window_end", "monitor_id"]).collect()
    }
    want = {
        (stamp(s), stamp(s + 60), m): (total, n, total / n)
        for (s, m), (total, n) in expected(everything, 1, 60).items()
    }
    assert got == want


def test_minute_store_keeps_last_window_of_each_minute(spark, feed, tmp_path):
    folder, add = feed
    everything = lines_of(60, seed=2)
    add(everything[::2])
    add(everything[1::2])
    stream = windows.camera_windows(readings(spark, folder, 2), watermark="20 minutes")
    batches = finish(spark, run.start_updates, stream)
    last = {}
    for (start, camera), value in sorted(expected(everything, 2, 20).items()):
        end = stamp(start + 20)
        last[(end[:10].replace("-", ""), camera, end[11:13] + end[14:16])] = value
    got = {(r.day, r.camera_id, r.hhmm): (r.speed_sum, r.n) for r in minute_store.minute_store(batches).collect()}
    assert got == last


def test_minute_store_is_merged_batch_by_batch(spark, feed, tmp_path):
    folder, add = feed
    everything = lines_of(90, seed=3)
    for k in range(3):
        add(everything[k::3])
    stream = windows.camera_windows(readings(spark, folder, 2), watermark="20 minutes")
    path = str(tmp_path / "store")
    query = minute_store.start_minute_store(stream, path, str(tmp_path / "checkpoint"))
    run.finish(query)
    last = {}
    for (start, camera), value in sorted(expected(everything, 2, 20).items()):
        end = stamp(start + 20)
        last[(end[:10].replace("-", ""), camera, end[11:13] + end[14:16])] = value

    def stored():
        rows = minute_store.read_minute_log(spark, path).collect()
        assert len(rows) == len(last)
        return {(r.day, r.camera_id, r.hhmm): (r.speed_sum, r.n) for r in rows}

    assert stored() == last
    # Neither stale windows nor a replayed batch change anything.
    log = minute_store.minute_log(spark, path)
    stale = log.read().withColumn("n", F.lit(99))
    minute_store.add_windows(log, stale.withColumn("window_end", F.lit("2000")), 50)
    versions = log.versions()
    minute_store.add_windows(log, stale, 2)
    assert stored() == last and log.versions() == versions


def test_upsert_keeps_the_latest_window(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("20240101", "k1", "0101", 5, 1, "2024-01-01 01:01:20"), ("20240101", "k2", "0101", 7, 2, "2024-01-01 01:01:20")]
    fresh = spark.createDataFrame(rows, "day string, camera_id string, hhmm string, speed_sum bigint, n bigint, window_end string")
    sinks.upsert_minute_speed(fresh, path)
    sinks.upsert_minute_speed(fresh.withColumn("n", F.lit(99).cast("bigint")).withColumn("window_end", F.lit("2000")), path)
    got = {(r.day, r.camera_id, r.hhmm, r.speed_sum, r.n) for r in tables.read_minute_speed(spark, path).collect()}
    assert got == {r[:5] for r in rows}


def test_dropped_rows_are_reported(spark, feed, tmp_path):
    folder, add = feed
    add([line("c", "m", "k", 5000, 50)])
    add([line("c", "m", "k", 6000, 50)])
    add([line("c", "m", "k", 1, 50)])
    for k, name in enumerate(sorted(os.listdir(folder))):
        os.utime(f"{folder}/{name}", (1_700_000_000 + 60 * k,) * 2)
    lines = read_lines(spark, StreamSpec("text", path=folder, options={"maxFilesPerTrigger": "1"}))
    stream = windows.camera_windows(parse.parse_readings(lines, key_at=2, speed_at=5, time_at=4))
    with pytest.raises(RuntimeError, match="late rows"):
        run.finish(run.start_updates(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))


def test_early_drops_are_remembered(spark, feed, tmp_path):
    """The query itself keeps two reports here; the late row falls into the third of eight batches."""
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        folder, add = feed
        for k, seconds in enumerate([5000, 6000, 1, *range(7000, 12000, 1000)]):
            add([line("c", "m", "k", seconds, 50)])
            os.utime(f"{folder}/{k:04d}.txt", (1_700_000_000 + 60 * k,) * 2)
        stream = windows.camera_windows(readings(spark, folder, 2))
        with pytest.raises(RuntimeError, match="2 late rows|late rows"):
            run.finish(run.start_updates(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    finally:
        spark.conf.set(name, before)


def test_panes_equal_windows_and_hold_a_sixth_of_the_state(spark, feed, tmp_path):
    folder, add = feed
    # One pass a minute and monitor at most, so that windows share no panes.
    everything = [line("c", f"m{k % 2}", "k", 60 * k, 10 + k) for k in range(40)]
    for i in range(3):
        add(everything[i::3])
    keys = ["window_start", "window_end", "monitor_id"]
    found, state = {}, {}
    for kind in ("windows", "panes"):
        base = str(tmp_path / kind)
        rows = readings(spark, folder, 1)
        if kind == "windows":
            query = run.start_updates(windows.congestion(rows, "2 hours"), f"{base}/out", f"{base}/checkpoint")
        else:
            query = windows.start_congestion_panes(rows, base, f"{base}/checkpoint", "2 hours")
        run.finish(query)
        batches = run.read_batches(spark, f"{base}/out", windows.congestion(rows).schema)
        found[kind] = sorted(map(tuple, run.latest(batches, keys).collect()))
        state[kind] = run.state_table(spark, f"{base}/checkpoint").count()
    assert found["panes"] == found["windows"] and len(found["panes"]) == 240
    assert state == {"windows": 240, "panes": 40}


def test_a_stopped_query_goes_on_from_its_checkpoint(spark, feed, tmp_path):
    folder, add = feed
    everything = lines_of(80, seed=5)
    for i in range(4):
        add(everything[i::4])
    base = str(tmp_path)
    stream = windows.congestion(readings(spark, folder, 1), watermark="20 minutes")
    query = run.start_updates(stream, f"{base}/out", f"{base}/checkpoint", {"processingTime": "0 seconds"})
    run.stop_after(query, 2)
    assert not query.isActive
    kept = run.state_table(spark, f"{base}/checkpoint").count()
    first = run.read_batches(spark, f"{base}/out", stream.schema).select("batch_id").distinct().count()
    assert kept > 0 and first >= 2
    run.finish(run.start_updates(stream, f"{base}/out", f"{base}/checkpoint"))
    batches = run.read_batches(spark, f"{base}/out", stream.schema)
    got = {(r.window_start, r.monitor_id): (r.speed_sum, r.car_count) for r in run.latest(batches, ["window_start", "window_end", "monitor_id"]).collect()}
    assert got == {(stamp(s), m): v for (s, m), v in expected(everything, 1, 60).items()}


def test_malformed_lines_give_no_reading(spark):
    rows = [("a\tm\tk\tc\tnot a time\t5",), ("short",), ("d\tm\tk\tc\t2024-01-01 24:00:01\tx",)]
    lines = spark.createDataFrame(rows + [("d\tm\tk\tc\t2024-01-01 24:00:01\t7",)], "value string")
    got = parse.parse_readings(lines, key_at=1, speed_at=5, time_at=4).collect()
    assert [(r.key, r.speed) for r in got] == [("m", 7)]


def test_readings_without_time_field_use_arrival(spark):
    lines = spark.createDataFrame([("k1\tx\ty\t42\tz",)], "value string")
    row = parse.parse_readings(lines, key_at=0, speed_at=3).select(
        "key", "speed", (F.abs(F.unix_seconds("event_time") - F.unix_seconds(F.current_timestamp())) < 60).alias("now")
    )
    assert tuple(row.first()) == ("k1", 42, True)


def test_watch_list_is_read_again_for_every_batch(spark, feed, tmp_path):
    folder, add = feed
    listed = tmp_path / "watch"
    listed.mkdir()
    (listed / "list.txt").write_text("c1\n")
    passes = parse.parse_passes(read_lines(spark, StreamSpec("text", path=folder)))
    base = scratch_dir(spark, "alerts")

    def start(stream, out, checkpoint):
        return run.start_watch_list(stream, str(listed), out, checkpoint)

    add([line("c1", "m", "k", 0, 1), line("c2", "m", "k", 1, 1)])
    first = finish(spark, start, passes, base)
    assert [r.car for r in first.collect()] == ["c1"]
    (listed / "list.txt").write_text("c2\nc3\n")
    add([line("c1", "m", "k", 2, 1), line("c2", "m", "k", 3, 1)])
    both = finish(spark, start, passes, base)
    assert sorted((r.batch_id, r.car) for r in both.collect()) == [(0, "c1"), (1, "c2")]


def test_replayed_batch_replaces_its_output(spark):
    base = scratch_dir(spark, "replay")
    write = run.write_batch(base)
    df = spark.range(3)
    write(df, 0)
    write(df, 0)
    assert run.read_batches(spark, base, df.schema).count() == 3


def test_kafka_options():
    spec = StreamSpec("kafka", brokers="b1:9092,b2:9092", topics=("t1", "t2"))
    assert kafka_options(spec) == {
        "kafka.bootstrap.servers": "b1:9092,b2:9092",
        "subscribe": "t1,t2",
        "startingOffsets": "latest",
    }
    with pytest.raises(ValueError):
        kafka_options(StreamSpec("kafka"))


def test_unknown_stream_kind(spark):
    with pytest.raises(ValueError):
        read_lines(spark, StreamSpec("socket"))
