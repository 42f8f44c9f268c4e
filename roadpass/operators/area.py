"""Road flow per area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpass.functions.classes import flow_level
from roadpass.operators import histogram
from roadpass.operators.skew import salted_count

ROADS_PER_AREA = 3


def with_area(passes: DataFrame, areas: DataFrame) -> DataFrame:
    """Add the area name; passes of unknown areas are dropped. The dimension is joined by
    Catalyst's own size estimate, so it is broadcast only while it is small."""
    names = areas.select(F.col("area_id").cast("string"), "area_name")
    return passes.join(names, "area_id", "inner")


def area_road_flow(passes: DataFrame, areas: DataFrame, salts: int | None = None) -> DataFrame:
    """Passes and per-monitor histogram for each (area, road).

    Passes are counted per (area, road, monitor) first; the dimension join and the
    histogram only see those counts. ``salts`` spreads hot groups over sub-keys.
    """
    keys = ["area_id", "road_id"]
    flow = passes.select(*keys, "monitor_id", "pass_id")
    if salts:
        counts = salted_count(flow, keys, "monitor_id", salts)
    else:
        counts = histogram.value_counts(flow, keys, "monitor_id")
    known = with_area(counts, areas)
    return histogram.render(known, keys, "monitor_id", "monitor_infos", "car_count")


def top_roads(flow: DataFrame, per_area: int = ROADS_PER_AREA) -> DataFrame:
    """The busiest roads of each area with their flow level."""
    busiest = Window.partitionBy("area_id").orderBy(F.desc("car_count"), "road_id")
    return (
        flow.withColumn("rank", F.row_number().over(busiest))
        .where(F.col("rank") <= per_area)
        .select(
            "area_id",
            "road_id",
            "car_count",
            "monitor_infos",
            flow_level(F.col("car_count")).alias("flow_level"),
        )
    )
