"""The keyed log and what is built on it."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from roadpass.sinks.keyed_log import KeyedLog, Manifest
from roadpass.streaming.range_lists import RangeLists
from roadpass.operators import tracks

SCHEMA = "k string, v bigint, at bigint, gone boolean"


@pytest.fixture
def log(spark, tmp_path):
    return KeyedLog(spark, str(tmp_path / "log"), SCHEMA, ["k"], ["at"], gone="gone")


def frame(spark, rows):
    return spark.createDataFrame([(k, v, at, gone) for k, v, at, gone in rows], SCHEMA)


def state(log, version=None):
    return {r.k: r.v for r in log.read(version).collect()}


def test_newest_state_wins_and_gone_keys_stay_gone(spark, log):
    assert state(log) == {}
    log.append(frame(spark, [("a", 1, 1, False), ("b", 2, 1, False)]))
    log.append(frame(spark, [("a", 3, 2, False), ("b", None, 2, True), ("c", 9, 1, False)]))
    assert state(log) == {"a": 3, "c": 9} and state(log, 1) == {"a": 1, "b": 2}
    log.append(frame(spark, [("a", 0, 0, False)]))
    assert state(log) == {"a": 3, "c": 9}
    before = log.versions()
    assert log.compact(fan_in=3) == 3 and len(log.manifest().folders) == 1
    assert state(log) == {"a": 3, "c": 9} and state(log, 1) == {"a": 1, "b": 2}
    assert log.versions() == [*before, before[-1] + 1]
    assert len(log.vacuum()) == 3 and state(log) == {"a": 3, "c": 9} and len(log.versions()) == 1


def test_a_replay_adds_nothing_and_a_batch_writes_only_its_rows(spark, log):
    for k in range(3):
        log.append(frame(spark, [(f"k{k}", k, 1, False)]), "w", k)
    folders = sorted(os.listdir(f"{log.path}/deltas"))
    log.append(frame(spark, [("k1", 77, 9, False)]), "w", 1)
    assert sorted(os.listdir(f"{log.path}/deltas")) == folders and log.versions() == [1, 2, 3]
    assert state(log) == {"k0": 0, "k1": 1, "k2": 2}
    assert [spark.read.parquet(f"{log.path}/{f}").count() for f, _ in log.manifest().folders] == [1, 1, 1]
    # Another writer's batch of the same number counts.
    log.append(frame(spark, [("k1", 77, 9, False)]), "other", 1)
    assert state(log)["k1"] == 77


def test_a_crash_between_write_and_commit_loses_nothing(spark, log, monkeypatch):
    log.append(frame(spark, [("a", 1, 1, False)]), "w", 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedLog, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.append(frame(spark, [("a", 2, 2, False)]), "w", 1)
    assert state(log) == {"a": 1}
    log.append(frame(spark, [("a", 2, 2, False)]), "w", 1)
    assert state(log) == {"a": 2} and len(os.listdir(f"{log.path}/deltas")) == 3
    log.vacuum()
    assert len(os.listdir(f"{log.path}/deltas")) == 2 and state(log) == {"a": 2}


def test_writers_that_race_both_commit(spark, log, monkeypatch):
    """Another writer takes the version between a writer's look and its commit."""
    log.append(frame(spark, [("a", 1, 1, False)]))
    real, raced = KeyedLog._commit, []

    def commit(self, manifest: Manifest):
        if not raced:
            raced.append(True)
            KeyedLog(spark, log.path, SCHEMA, ["k"], ["at"], gone="gone").append(frame(spark, [("b", 5, 1, False)]))
        return real(self, manifest)

    monkeypatch.setattr(KeyedLog, "_commit", commit)
    log.append(frame(spark, [("c", 6, 1, False)]))
    assert state(log) == {"a": 1, "b": 5, "c": 6} and log.versions() == [1, 2, 3]


def test_compaction_rewrites_each_row_a_few_times(spark, log):
    for k in range(16):
        log.append(frame(spark, [(f"k{k}", k, 1, False)]), "w", k)
        log.compact(fan_in=4)
    assert [c for _, c in log.manifest().folders] == [2]
    assert state(log) == {f"k{k}": k for k in range(16)}


def test_range_lists_follow_every_increment(spark, make_passes, tmp_path):
    rng = random.Random(3)
    lists = RangeLists(spark, str(tmp_path / "ranges"))
    rows = []
    for batch in range(4):
        new = [
            (f"c{rng.randrange(6)}", f"m{rng.randrange(3)}", f"2024-01-0{rng.randrange(1, 3)} 10:{rng.randrange(60):02d}:00")
            for _ in range(12)
        ]
        rows += new
        before = lists.ranges.rows().count()
        lists.add(make_passes(new), batch)
        want = sorted(map(tuple, tracks.range_cars(make_passes(rows)).collect()))
        assert sorted(map(tuple, lists.read().collect())) == want
        if batch:
            touched = {(r.monitor_id, r.start) for r in lists.ranges.rows().where(F.col("batch_id") == batch).collect()}
            assert lists.ranges.rows().count() - before <= len(touched) <= 24
    lists.add(make_passes(new), 3)
    assert sorted(map(tuple, lists.read().collect())) == want


def test_range_lists_survive_a_stop_between_their_commits(spark, make_passes, tmp_path, monkeypatch):
    lists = RangeLists(spark, str(tmp_path / "ranges"))
    first, second = [("a", "m", "2024-01-01 10:01:00"), ("b", "m", "2024-01-01 10:02:00")], [("a", "m", "2024-01-01 11:01:00")]
    lists.add(make_passes(first), 0)
    with monkeypatch.context() as m:
        m.setattr(lists.visits, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            lists.add(make_passes(second), 1)
    lists.add(make_passes(second), 1)
    lists.add(make_passes([("b", "m", "2024-01-01 11:02:00")]), 2)
    assert [r.cars for r in lists.read().collect()] == ["a=2024-01-01 11:01:00|b=2024-01-01 11:02:00"]
