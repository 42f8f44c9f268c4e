from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("roadpass-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_passes(spark):
    """Passes from (car, monitor, time) with optional fields by keyword."""
    from roadpass.schemas import PASS_LOG
    from roadpass.sources.tables import typed_passes

    def build(rows):
        raw = []
        for row in rows:
            car, monitor, time, *rest = row
            extra = rest[0] if rest else {}
            raw.append(
                (
                    extra.get("date", time[:10]),
                    monitor,
                    extra.get("camera", "00000"),
                    car,
                    time,
                    str(extra.get("speed", 50)),
                    extra.get("road", "1"),
                    extra.get("area", "00"),
                )
            )
        return typed_passes(spark.createDataFrame(raw, PASS_LOG))

    return build
