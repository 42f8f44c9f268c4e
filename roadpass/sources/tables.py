"""Batch inputs: text logs, catalog tables, JDBC tables and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass import schemas
from roadpass.functions import timekeys as K
from roadpass.functions.text import tab_fields, to_int


def typed_passes(raw: DataFrame) -> DataFrame:
    """Type the text columns of a pass log once.

    ``ts`` is the parsed time (NULL when malformed), ``pass_id`` a stable row id used
    to order passes of the same second; a log without ids gets a hash of its fields.
    """
    ts = K.parse_time(F.col("action_time"))
    pass_id = F.col("pass_id") if "pass_id" in raw.columns else F.xxhash64(*schemas.PASS_LOG.names)
    return raw.select(
        "date",
        "monitor_id",
        "camera_id",
        "car",
        F.coalesce(K.time_text(ts), F.col("action_time")).alias("action_time"),
        to_int(F.col("speed")).alias("speed"),
        "road_id",
        "area_id",
        ts.alias("ts"),
        pass_id.alias("pass_id"),
    )


def read_pass_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated pass log; quote marks are ordinary characters."""
    return typed_passes(tab_fields(spark.read.text(path), schemas.PASS_LOG.names))


def read_passes(spark: SparkSession, path: str) -> DataFrame:
    """Passes stored by ``write_passes``."""
    return spark.read.schema(schemas.PASSES).parquet(path).select(*schemas.PASSES.names)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated camera registry."""
    return tab_fields(spark.read.text(path), schemas.REGISTRY.names)


def read_catalog_passes(spark: SparkSession, table: str = "monitor_flow_action") -> DataFrame:
    return typed_passes(spark.table(table))


def read_catalog(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def jdbc_options(
    url: str,
    table: str,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition: tuple[str, int, int, int] | None = None,
) -> dict[str, str]:
    """Options of a JDBC read; ``partition`` is (column, lower, upper, count) for a
    parallel scan."""
    options = {"url": url, "dbtable": table}
    for key, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[key] = value
    if partition:
        column, lower, upper, count = partition
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(count),
        }
    return options


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def read_areas(spark: SparkSession, **options) -> DataFrame:
    """The area dimension from a JDBC database; ids become text."""
    areas = read_jdbc(spark, table="area_info", **options)
    return areas.select(F.col("area_id").cast("string"), "area_name")


def read_watch_list(spark: SparkSession, path: str) -> DataFrame:
    """One plate per line."""
    return spark.read.text(path).select(F.trim("value").alias("car")).where("car <> ''")


def read_minute_speed(
    spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """Stored minute speeds (partitioned by day), pruned to the given days."""
    store = spark.read.schema(schemas.MINUTE_SPEED).parquet(path).select(*schemas.MINUTE_KEYS, "speed_sum", "n")
    if first_day is not None:
        store = store.where(F.col("day") >= first_day)
    if last_day is not None:
        store = store.where(F.col("day") <= last_day)
    return store
