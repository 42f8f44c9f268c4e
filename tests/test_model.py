from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from roadpass.ml import features, model
from roadpass.session import scratch_dir

DAY = "20240115"
RELATIONS = [("a", 0, "a"), ("a", 1, "b"), ("b", 0, "a"), ("b", 1, "b"), ("z", 0, "q"), ("z", 1, "a")]


def hhmm(minute: int) -> str:
    return f"{minute // 60:02d}{minute % 60:02d}"


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(4)
    rows = []
    for camera in "abq":
        for minute in rng.sample(range(60, 200), 70):
            rows.append((DAY, camera, hhmm(minute), rng.randrange(1000), rng.randrange(1, 9)))
    return spark.createDataFrame(rows, "day string, camera_id string, hhmm string, speed_sum long, n long")


@pytest.fixture(scope="module")
def relations(spark):
    return spark.createDataFrame(RELATIONS, "camera_id string, pos int, related_id string")


def naive(store, camera, minute, first=3):
    known = {(r.camera_id, r.hhmm): r.speed_sum / r.n for r in store.collect()}
    related = [r for c, _, r in RELATIONS if c == camera]
    vector = [known.get((r, hhmm(minute - lag)), -1.0) for lag in range(first, first - 3, -1) for r in related]
    return vector, known.get((camera, hhmm(minute)))


def test_training_rows_match_direct_lookup(store, relations):
    rows = features.training_rows(store, relations, width=2).collect()
    # Camera z is not among its own related cameras, so it has no labels.
    assert {r.camera_id for r in rows} == {"a", "b"} and len(rows) == 140
    for r in rows:
        minute = int(r.hhmm[:2]) * 60 + int(r.hhmm[2:])
        vector, label = naive(store, r.camera_id, minute)
        assert list(r.features) == vector and r.label_speed == label
        assert r.label == min(int(label) // 10, 10) and r.day == DAY


def test_training_window_is_relative_to_its_end(store, relations):
    got = features.training_rows(store, relations, until=(DAY, "0230"), hours=1, width=2).collect()
    whole = features.training_rows(store, relations, width=2).collect()
    # The oldest feature minute runs from 57 minutes to 1 minute before the end.
    inside = {(r.camera_id, r.hhmm): list(r.features) for r in whole if "0136" <= r.hhmm <= "0232"}
    assert {(r.camera_id, r.hhmm): list(r.features) for r in got} == inside


def test_rows_at_covers_every_camera(store, relations):
    rows = features.rows_at(store, relations, DAY, "0150", width=2, max_relations=6).collect()
    assert {r.camera_id for r in rows} == {"a", "b", "z"}
    for r in rows:
        assert list(r.features) == naive(store, r.camera_id, 111)[0]
    early = features.rows_at(store, relations, DAY, "0001", width=2).collect()
    assert {tuple(r.features) for r in early} == {(-1.0,) * 6}
    empty = features.rows_at(store, relations, "20300101", "0000", width=2).collect()
    assert {tuple(r.features) for r in empty} == {(-1.0,) * 6}


def test_lists_of_any_length_and_own_camera_anywhere(spark, store):
    listed = [("a", k, "b") for k in range(6)] + [("a", 6, "a"), ("b", 0, "q"), ("q", 0, "a"), ("q", 1, "b")]
    relations = spark.createDataFrame(listed, "camera_id string, pos int, related_id string")
    assert features.relation_width(relations) == 7
    rows = features.training_rows(store, relations, width=7).collect()
    known = {(r.camera_id, r.hhmm): r.speed_sum / r.n for r in store.collect()}
    # Every own reading gives a row, whether or not the camera stands in its list.
    assert {(r.camera_id, r.hhmm) for r in rows} == {(c, m) for c, m in known if c in "abq"}
    for r in rows:
        minute = int(r.hhmm[:2]) * 60 + int(r.hhmm[2:])
        want = []
        for lag in (3, 2, 1):
            lists = {p: related for c, p, related in listed if c == r.camera_id}
            want += [known.get((lists.get(p), hhmm(minute - lag)), -1.0) for p in range(7)]
        assert list(r.features) == want and r.label_speed == known[(r.camera_id, r.hhmm)]


def test_position_beyond_the_width_is_an_error(spark, store):
    relations = spark.createDataFrame([("a", 5, "b")], "camera_id string, pos int, related_id string")
    with pytest.raises(Exception, match="beyond width 5"):
        features.training_rows(store, relations, width=5).collect()


def test_split_is_complete_and_stable(store, relations):
    rows = features.training_rows(store, relations, width=2)
    train, test = features.split(rows)
    assert train.count() + test.count() == rows.count()
    again, _ = features.split(rows.repartition(5))
    keys = ["camera_id", "hhmm"]
    assert sorted(map(tuple, train.select(keys).collect())) == sorted(map(tuple, again.select(keys).collect()))


@pytest.fixture(scope="module")
def steady(spark):
    """Camera speeds that never change, so the class can be learned."""
    rows = [
        (c, DAY, hhmm(m), [v] * 6, v, v // 10) for c, v in (("a", 20.0), ("b", 70.0)) for m in range(60)
    ]
    return spark.createDataFrame(
        rows, "camera_id string, day string, hhmm string, features array<double>, label_speed double, label double"
    )


def test_accepted_model_is_stored_and_used(spark, steady):
    trained = model.train(steady, max_iter=20, size=6)
    assert trained.accepted and trained.precision == 1.0
    base = scratch_dir(spark, "models")
    assert model.save(spark, trained, base, "v9")
    untrained = model.Trained(model.fit(steady.withColumn("label", F.lit(0.0)), 6, max_iter=1), 1.0, True)
    assert model.save(spark, untrained, base, "v11")
    # The newest by time, not by name.
    assert model.save(spark, trained, base, "v10")
    again = model.load(spark, base)
    scored = model.predict(again, steady.drop("label"))
    assert scored.where(F.col("prediction") != F.floor(F.col("label_speed") / 10)).count() == 0


def test_rejected_model_is_not_stored(spark, steady):
    trained = model.Trained(None, 0.8, 0.8 > model.ACCEPTANCE)
    assert not model.save(spark, trained, scratch_dir(spark, "models"), "v1")


def test_models_of_single_cameras(spark, steady):
    mixed = steady.withColumn("label", F.when(F.col("hhmm") < "0030", F.col("label")).otherwise(F.lit(1.0)))
    mixed = mixed.withColumn(
        "features", F.when(F.col("hhmm") < "0030", F.col("features")).otherwise(F.array_repeat(F.lit(-1.0), 6))
    )
    got = model.train_cameras(mixed, ["a", "b"], max_iter=30, size=6)
    assert set(got) == {"a", "b"} and all(t.accepted for t in got.values())
