"""Writers for the result tables.

Results are stored in one folder per task and a write replaces its own task's folder
only, also when the new result is empty. A rerun or a retried write therefore never
doubles rows, and no read-modify-write on the table is needed.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass import schemas
from roadpass.schemas import OUTPUTS
from roadpass.session import release, stored


def shaped(df: DataFrame, table: str, task_id: int) -> DataFrame:
    """Project a result to the columns of its output table."""
    return df.withColumn("task_id", F.lit(task_id).cast("bigint")).select(*OUTPUTS[table])


def write_result(df: DataFrame, base: str, table: str, task_id: int) -> None:
    rows = shaped(df, table, task_id).drop("task_id")
    rows.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{table}/task_id={task_id}")


def _stored_at(spark: SparkSession, path: str, schema, column: str, values: DataFrame) -> DataFrame:
    """Rows of a partitioned table whose ``column`` is among ``values``; none without a table."""
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return table.join(values.select(column).distinct(), column, "left_semi").select(*table.columns)


# Rows of a row group that plate lookups skip or read as a whole, about, and its plates.
PLATES_A_GROUP = 50_000


def write_passes(passes: DataFrame, path: str, replace: bool = False, by_car: bool = False, group_bytes: int | None = None) -> None:
    """Store typed passes by ``date``.

    Dates that are stored already are refused, since a part of a date would erase the
    rest; ``replace`` says that the frame holds its dates whole, ``add_passes`` is for late
    ones. Date ranges prune folders. The rebalance lets adaptive execution split the files
    of a crowded date and merge those of a quiet one.

    ``by_car`` serves plate lookups: files of a date hold ranges of plates, so a lookup opens
    few of them, and row groups (of ``group_bytes``, Parquet's own default if None) carry a Bloom
    filter of their plates, which rules out those whose range covers a plate without holding it.
    """
    spark = passes.sparkSession
    if not replace:
        old = _stored_at(spark, path, schemas.PASSES, "date", passes).select("date").first()
        if old is not None:
            raise ValueError(f"passes of {old.date} are stored already; use replace=True or add_passes")
    dealt = passes.hint("rebalance", "date")
    if by_car:
        dealt = passes.repartitionByRange("date", "car").sortWithinPartitions("date", "car")
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date")
    if by_car:
        writer.option("parquet.bloom.filter.enabled#car", "true").option("parquet.bloom.filter.expected.ndv#car", str(PLATES_A_GROUP))
        if group_bytes:
            writer.option("parquet.block.size", str(group_bytes))
    writer.parquet(path)


def add_passes(passes: DataFrame, path: str) -> None:
    """Add late passes to their dates. A pass (date and pass_id) that is stored stays as it
    is, so a repeated call adds nothing."""
    old = _stored_at(passes.sparkSession, path, schemas.PASSES, "date", passes)
    new = passes.select(*schemas.PASSES.names).join(old.select("date", "pass_id"), ["date", "pass_id"], "left_anti")
    # Written elsewhere first: a table cannot be read and overwritten by one query.
    whole = stored(old.select(*schemas.PASSES.names).unionByName(new.select(*schemas.PASSES.names)), "passes")
    write_passes(whole, path, replace=True)
    release(passes.sparkSession, whole.scratch_path)


def jdbc_write_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    batch_rows: int = 1000,
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "batchsize": str(batch_rows)}
    for key, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[key] = value
    return options


def append_jdbc(df: DataFrame, table: str, task_id: int, url: str, **options) -> None:
    """Append to a database table, written by the executors in batches per partition.

    A database append cannot replace: a failed and repeated write may leave rows twice.
    """
    writer = shaped(df, table, task_id).write.format("jdbc").mode("append")
    writer.options(**jdbc_write_options(url, table, **options)).save()


def upsert_minute_speed(minutes: DataFrame, path: str) -> None:
    """Merge minutes into the store by (day, camera_id, hhmm).

    Of a stored and a new row the one with the later ``window_end`` stays, then the later
    ``batch_id``; frames without these columns win over what is stored. Other minutes of
    the day stay, and repeating a merge changes nothing.
    """
    for column, kind in (("window_end", "string"), ("batch_id", "bigint")):
        if column not in minutes.columns:
            # Sorts after every time text and batch number.
            last = F.lit("~") if kind == "string" else F.lit(2**62)
            minutes = minutes.withColumn(column, last.cast(kind))
    names = ["camera_id", "hhmm", "speed_sum", "n", "window_end", "batch_id", "day"]
    new = minutes.select(*names)
    old = _stored_at(minutes.sparkSession, path, schemas.MINUTE_SPEED, "day", new).select(*names)
    values = F.struct(*names[2:6])
    both = old.withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    kept = both.groupBy(*schemas.MINUTE_KEYS).agg(F.max_by(values, F.struct("window_end", "batch_id", "new")).alias("v"))
    merged = stored(kept.select(*schemas.MINUTE_KEYS, "v.*").select(*names), "minutes")
    (
        merged.hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
    release(minutes.sparkSession, merged.scratch_path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Replace the predictions of the (day, hhmm) pairs present in the frame."""
    (
        predictions.select("camera_id", "prediction", "day", "hhmm")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "hhmm")
        .parquet(path)
    )
