"""One speed-class model for each camera, all cameras at once.

Multinomial logistic regression with a ridge, by L-BFGS. Every pass over the data evaluates
one trial point of every camera that is not done: blocks of packed rows give partial losses
and gradients, which are summed up per camera and handed to the camera's optimiser,
whose state is a row of a table. A pass is one Spark job for any number of cameras, a
camera's rows may lie in any number of tasks, and only the count of open cameras reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpass.ml.features import split
from roadpass.ml.model import ACCEPTANCE
from roadpass.session import release, stored

CLASSES = 11
RIDGE = 1e-3
# Speeds in hundreds, so that weights and intercepts are of one size.
SCALE = 0.01
BLOCKS = 16
MEMORY = 6
MAX_PASSES = 60
TOLERANCE = 1e-4
MIN_ROWS = 30

_PACKED = "camera_id string, n long, x binary, y binary"
_STATE = "camera_id string, trial binary, state binary, passes int, done boolean"


def fit_cameras(
    rows: DataFrame, size: int, classes: int = CLASSES, ridge: float = RIDGE, max_passes: int = MAX_PASSES, tolerance: float = TOLERANCE
) -> DataFrame:
    """(camera_id, coefficients, passes) from feature rows (camera_id, features, label).

    ``coefficients`` holds for each class its ``size`` weights and the intercept, for
    features as they are. Minimised is the mean loss plus half the ridge times the squared
    weights of the scaled features. Rows with a null label or camera are left out.
    """
    known = rows.where(F.col("camera_id").isNotNull() & F.col("label").isNotNull())
    block = F.pmod(F.xxhash64("features", "label", F.monotonically_increasing_id()), F.lit(BLOCKS)).alias("block")
    packed = stored(
        known.select("camera_id", "features", "label", block).groupBy("camera_id", "block").applyInArrow(_pack(size), _PACKED), "packed-rows"
    )
    width = classes * (size + 1)
    blank = F.lit(np.zeros(width).tobytes())
    states = stored(
        packed.select("camera_id").distinct().select(
            "camera_id", blank.alias("trial"), F.lit(b"").alias("state"), F.lit(0).alias("passes"), F.lit(False).alias("done")
        ),
        "states",
    )
    for _ in range(max_passes):
        open_ = states.where("not done")
        partial = packed.join(open_.select("camera_id", "trial"), "camera_id").mapInArrow(
            _gradients(size, classes), "camera_id string, n long, loss double, gradient binary"
        )
        moved = partial.groupBy("camera_id").cogroup(open_.groupBy("camera_id")).applyInArrow(_step(size, classes, ridge, tolerance), _STATE)
        new = stored(moved.unionByName(states.where("done")), "states")
        release(rows.sparkSession, states.scratch_path)
        states = new
        if states.where("not done").isEmpty():
            break
    release(rows.sparkSession, packed.scratch_path)
    return states.mapInArrow(_unscaled(size, classes), "camera_id string, coefficients array<double>, passes int")


def predicted(models: DataFrame, rows: DataFrame, size: int, classes: int = CLASSES) -> DataFrame:
    """The feature rows with a ``prediction`` column; null for cameras without a model."""
    both = rows.join(models.select("camera_id", "coefficients"), "camera_id", "left")
    score = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: _score(F.col("coefficients"), F.col("features"), k, size))
    best = F.array_position(score, F.array_max(score)) - 1
    return both.withColumn("prediction", best.cast("double")).drop("coefficients")


def _score(coefficients: Column, features: Column, k: Column, size: int) -> Column:
    mine = F.slice(coefficients, k * (size + 1) + 1, size)
    return F.aggregate(F.zip_with(mine, features, lambda w, v: w * v), F.get(coefficients, k * (size + 1) + size), lambda a, v: a + v)


def train_all(
    rows: DataFrame, size: int, classes: int = CLASSES, acceptance: float = ACCEPTANCE, min_rows: int = MIN_ROWS, seed: int = 1000
) -> DataFrame:
    """(camera_id, coefficients, n_train, n_test, hits, accepted) for every camera of the rows.

    Each camera's model is fitted on its training rows and passes its own gate: the share of
    its test rows whose class was predicted must exceed ``acceptance``. A camera with fewer
    than ``min_rows`` training rows gets no model.
    """
    training, test = split(rows, 0.6, seed)
    counts = training.groupBy("camera_id").agg(F.count("*").alias("n_train"))
    enough = counts.where(F.col("n_train") >= min_rows).select("camera_id")
    models = stored(fit_cameras(training.join(enough, "camera_id", "left_semi"), size, classes), "camera-models")
    scored = predicted(models, test, size, classes).groupBy("camera_id").agg(
        F.count("*").alias("n_test"), F.count_if(F.col("prediction") == F.col("label")).alias("hits")
    )
    # A camera may have rows on one side only.
    all_ = counts.join(scored, "camera_id", "full").join(models.select("camera_id", "coefficients"), "camera_id", "left")
    tested = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_train", "n_test", "hits")}
    passed = F.col("coefficients").isNotNull() & (F.col("hits") > acceptance * F.col("n_test"))
    return all_.select("camera_id", "coefficients", *tested.values()).withColumn("accepted", passed)


def save_accepted(trained: DataFrame, path: str, version: str) -> None:
    """Store the accepted models of a training run, replacing an earlier write of that version."""
    accepted = trained.where("accepted").select("camera_id", "coefficients")
    accepted.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def load_accepted(spark, path: str, version: str) -> DataFrame:
    return spark.read.schema("camera_id string, coefficients array<double>").parquet(f"{path.rstrip('/')}/version={version}")


def _pack(size: int):
    def run(group: pa.Table) -> pa.Table:
        x = group.column("features").combine_chunks().flatten().to_numpy().reshape(group.num_rows, size) * SCALE
        y = group.column("label").to_numpy().astype(np.int32)
        return pa.table(
            {"camera_id": group.column("camera_id")[:1], "n": [group.num_rows], "x": pa.array([x.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())}
        )

    return run


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over the rows; ``weights`` is (classes, size + 1), the intercept last."""
    score = x @ weights[:, :-1].T + weights[:, -1]
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    total = p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = float((np.log(total[:, 0]) - score[at, y]).sum())
    p /= total
    p[at, y] -= 1
    return loss, np.concatenate([p.T @ x, p.sum(axis=0)[:, None]], axis=1)


def _gradients(size: int, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"]).reshape(r["n"], size)
                weights = np.frombuffer(r["trial"]).reshape(classes, size + 1)
                loss, gradient = loss_and_gradient(x, np.frombuffer(r["y"], np.int32), weights)
                rows.append((r["camera_id"], r["n"], loss, gradient.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = pa.string(), pa.int64(), pa.float64(), pa.binary()
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["camera_id", "n", "loss", "gradient"])

    return run


class Search:
    """The L-BFGS state of one camera, between two evaluations."""

    def __init__(self, trial: np.ndarray, state: bytes):
        p = len(trial)
        values = np.frombuffer(state) if state else np.zeros(3 + 3 * p)
        self.trial = trial
        self.fresh = not state
        self.loss, self.step, count = values[:3]
        self.point, self.gradient, self.direction = values[3 : 3 + 3 * p].reshape(3, p)
        pairs = values[3 + 3 * p :].reshape(2, int(count), p)
        self.moves, self.turns = list(pairs[0]), list(pairs[1])

    def bytes(self) -> bytes:
        head = [np.array([self.loss, self.step, len(self.moves)]), self.point, self.gradient, self.direction]
        return np.concatenate([*head, *self.moves, *self.turns]).tobytes()

    def take(self, loss: float, gradient: np.ndarray, tolerance: float) -> bool:
        """Take in the value at the trial point and choose the next one; true when done."""
        if not self.fresh:
            slope = float(self.gradient @ self.direction)
            if loss > self.loss + 1e-4 * self.step * slope:
                self.step /= 2
                self.trial = self.point + self.step * self.direction
                return self.step < 1e-9
            move, turn = self.trial - self.point, gradient - self.gradient
            if move @ turn > 1e-12 * (turn @ turn):
                self.moves, self.turns = [*self.moves, move][-MEMORY:], [*self.turns, turn][-MEMORY:]
        gain = np.inf if self.fresh else self.loss - loss
        self.point, self.loss, self.gradient = self.trial, loss, gradient
        if np.abs(gradient).max() < tolerance or gain < tolerance * max(1e-3, abs(loss)) * 1e-2:
            return True
        self.direction = -self._scaled(gradient)
        self.step = 1.0 if self.moves else min(1.0, 1 / float(np.linalg.norm(gradient)))
        self.trial = self.point + self.step * self.direction
        return False

    def _scaled(self, gradient: np.ndarray) -> np.ndarray:
        q, parts = gradient.copy(), []
        for s, y in zip(reversed(self.moves), reversed(self.turns), strict=True):
            a = (s @ q) / (s @ y)
            q -= a * y
            parts.append(a)
        if self.moves:
            q *= (self.moves[-1] @ self.turns[-1]) / (self.turns[-1] @ self.turns[-1])
        for s, y, a in zip(self.moves, self.turns, reversed(parts), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        return q


def _step(size: int, classes: int, ridge: float, tolerance: float):
    def run(partial: pa.Table, state: pa.Table) -> pa.Table:
        (row,) = state.to_pylist()
        search = Search(np.frombuffer(row["trial"]), row["state"])
        # Summed in a fixed order, so that reruns agree.
        parts = sorted((r["gradient"], r["loss"], r["n"]) for r in partial.to_pylist())
        n = sum(p[2] for p in parts)
        weights = search.trial.reshape(classes, size + 1).copy()
        weights[:, -1] = 0
        gradient = sum(np.frombuffer(p[0]) for p in parts) / n + ridge * weights.ravel()
        loss = sum(p[1] for p in parts) / n + ridge / 2 * float((weights**2).sum())
        done = search.take(loss, gradient, tolerance)
        final = search.point if done else search.trial
        return pa.table(
            {
                "camera_id": [row["camera_id"]],
                "trial": pa.array([final.tobytes()], pa.binary()),
                "state": pa.array([b"" if done else search.bytes()], pa.binary()),
                "passes": pa.array([row["passes"] + 1], pa.int32()),
                "done": [done],
            }
        )

    return run


def _unscaled(size: int, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("trial").to_pylist():
                weights = np.frombuffer(raw).reshape(classes, size + 1).copy()
                weights[:, :-1] *= SCALE
                out.append(weights.ravel().tolist())
            yield pa.record_batch(
                [batch.column("camera_id"), pa.array(out, pa.list_(pa.float64())), batch.column("passes")], ["camera_id", "coefficients", "passes"]
            )

    return run
