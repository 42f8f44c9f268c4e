"""Training, acceptance, storage and use of the speed-class classifier."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass.ml.features import split

ACCEPTANCE = 0.8
POOLED = "*"
# ``registered_at`` counts nanoseconds since 1970.
REGISTRY = "camera_id string, path string, precision double, version string, registered_at bigint"


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    precision: float
    accepted: bool


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("speeds", array_to_vector("features"))


def _estimator(pooled: bool, max_iter: int, size: int) -> Pipeline:
    """Multinomial logistic regression on the speeds; a pooled model also gets the camera
    as a sparse one-hot vector, one place for each camera of the training rows and one for
    all others."""
    # The stated size spares the assembler a job that would look at the data for it.
    stages, inputs = [VectorSizeHint(inputCol="speeds", size=size, handleInvalid="error")], ["speeds"]
    if pooled:
        stages.append(StringIndexer(inputCol="camera_id", outputCol="camera_index", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCol="camera_index", outputCol="camera", dropLast=False))
        inputs.append("camera")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="vector"))
    stages.append(
        LogisticRegression(
            featuresCol="vector", labelCol="label", family="multinomial", regParam=0.0, maxIter=max_iter
        )
    )
    return Pipeline(stages=stages)


def fit(
    rows: DataFrame, size: int, pooled: bool = True, max_iter: int = 100
) -> PipelineModel:
    """Fit on feature rows of ``size`` values."""
    return _estimator(pooled, max_iter, size).fit(_vectors(rows))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The feature rows with a ``prediction`` column."""
    scored = model.transform(_vectors(rows))
    return scored.drop("speeds", "camera_index", "camera", "vector", "rawPrediction", "probability")


def precision(scored: DataFrame) -> float:
    """Share of rows whose class was predicted."""
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)


def train(
    rows: DataFrame,
    size: int,
    pooled: bool = True,
    max_iter: int = 100,
    seed: int = 1000,
    acceptance: float = ACCEPTANCE,
) -> Trained:
    """Fit on 60 percent of the rows, measure on the rest, accept above ``acceptance``."""
    training, test = split(rows, 0.6, seed)
    model = fit(training, size, pooled, max_iter)
    score = precision(predict(model, test))
    return Trained(model, score, score > acceptance)


def train_cameras(
    rows: DataFrame, cameras: list[str], size: int, max_iter: int = 100
) -> dict[str, Trained]:
    """One model for each camera of a short, explicit list."""
    return {
        camera: train(rows.where(F.col("camera_id") == camera), size, False, max_iter)
        for camera in cameras
    }


def save(spark: SparkSession, trained: Trained, base: str, version: str, camera: str = POOLED) -> bool:
    """Store an accepted model and register its path and time; a rejected model leaves no trace."""
    if not trained.accepted:
        return False
    name = "pooled" if camera == POOLED else camera
    path = f"{base}/models/{name}-{version}"
    trained.model.write().overwrite().save(path)
    entry = spark.createDataFrame(
        [(camera, path, trained.precision, version, time.time_ns())], REGISTRY
    )
    (
        entry.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("version")
        .parquet(f"{base}/registry/camera={name}")
    )
    return True


def load(spark: SparkSession, base: str, camera: str = POOLED) -> PipelineModel | None:
    """The model of a camera that was registered last."""
    name = "pooled" if camera == POOLED else camera
    entries = spark.read.schema(REGISTRY).parquet(f"{base}/registry/camera={name}")
    row = entries.orderBy(F.desc("registered_at")).select("path").first()
    return PipelineModel.load(row.path) if row else None
