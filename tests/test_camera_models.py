"""One model for each camera, all at once."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from roadpass.ml import camera_models as M

SIZE, CLASSES = 3, 3
SCHEMA = "camera_id string, day string, hhmm string, features array<double>, label double"


def planted(cameras, n, noise=0.0, seed=1):
    """The class is the place of the largest feature, shifted by the camera's number."""
    rng = random.Random(seed)
    rows = []
    for c in range(cameras):
        for k in range(n):
            x = [rng.uniform(0, 120) for _ in range(SIZE)]
            label = (max(range(SIZE), key=x.__getitem__) + c) % CLASSES
            if rng.random() < noise:
                label = rng.randrange(CLASSES)
            rows.append((f"k{c}", "20240101", f"{k:04d}", x, float(label)))
    return rows


def weights(models):
    return {r.camera_id: np.array(r.coefficients).reshape(CLASSES, SIZE + 1) for r in models.collect()}


@pytest.fixture(scope="module")
def noisy(spark):
    rows = planted(3, 150, noise=0.2)
    # A hot camera, and rows that cannot train.
    rows += [("hot", d, m, x, y) for _, d, m, x, y in planted(1, 900, noise=0.2, seed=9)]
    rows += [(None, "d", "m", [1.0] * SIZE, 0.0), ("k0", "d", "m", [1.0] * SIZE, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_all_at_once_equals_single_fits_and_the_library(spark, noisy):
    together = weights(M.fit_cameras(noisy, SIZE, CLASSES, ridge=0.01, tolerance=1e-7))
    assert set(together) == {"k0", "k1", "k2", "hot"}
    one = noisy.where("camera_id = 'hot'")
    single = weights(M.fit_cameras(one, SIZE, CLASSES, ridge=0.01, tolerance=1e-7))["hot"]
    np.testing.assert_allclose(single, together["hot"], rtol=1e-3, atol=1e-4)
    scaled = one.withColumn("x", array_to_vector(F.transform("features", lambda v: v * M.SCALE)))
    fitted = LogisticRegression(
        featuresCol="x", family="multinomial", regParam=0.01, standardization=False, maxIter=300, tol=1e-10
    ).fit(scaled)
    want = fitted.coefficientMatrix.toArray() * M.SCALE
    np.testing.assert_allclose(together["hot"][:, :-1], want, rtol=0.02, atol=2e-4)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    x, y, w = rng.normal(size=(40, SIZE)), rng.integers(0, CLASSES, 40), rng.normal(size=(CLASSES, SIZE + 1))
    loss, gradient = M.loss_and_gradient(x, y, w)
    for at in np.ndindex(*w.shape):
        moved = w.copy()
        moved[at] += 1e-6
        assert (M.loss_and_gradient(x, y, moved)[0] - loss) / 1e-6 == pytest.approx(gradient[at], rel=1e-3, abs=1e-4)


def test_each_camera_has_its_own_rule_and_gate(spark, tmp_path):
    rows = planted(3, 200) + [("few", d, m, x, y) for _, d, m, x, y in planted(1, 12, seed=3)]
    rows += [("random", d, m, x, float(random.Random(m).randrange(CLASSES))) for _, d, m, x, _ in planted(1, 200, seed=4)]
    trained = M.train_all(spark.createDataFrame(rows, SCHEMA).repartition(4), SIZE, CLASSES)
    got = {r.camera_id: r for r in trained.collect()}
    assert {c for c, r in got.items() if r.accepted} == {"k0", "k1", "k2"}
    assert all(got[c].hits >= 0.9 * got[c].n_test for c in ("k0", "k1", "k2"))
    assert got["few"].coefficients is None and got["random"].coefficients is not None and got["random"].hits < 0.7 * got["random"].n_test
    M.save_accepted(trained, str(tmp_path), "v1")
    M.save_accepted(trained, str(tmp_path), "v1")
    loaded = M.load_accepted(spark, str(tmp_path), "v1")
    assert sorted(r.camera_id for r in loaded.collect()) == ["k0", "k1", "k2"]
    scored = M.predicted(loaded, spark.createDataFrame(rows, SCHEMA), SIZE, CLASSES)
    assert scored.where("prediction is null").select("camera_id").distinct().count() == 2


def test_no_rows_give_no_models(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.fit_cameras(none, SIZE, CLASSES).count() == 0
    assert M.train_all(none, SIZE, CLASSES).count() == 0
