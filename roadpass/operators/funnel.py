"""Conversion along a sequence of monitors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpass.functions import timekeys as K
from roadpass.functions.classes import round_rate

SLICE_SECONDS = 3600


def _lent(base: DataFrame, depth: int) -> DataFrame:
    """For each hour of a car, the next ``depth`` passes from its later hours.

    Only the first ``depth`` passes of every hour can be among them, so the second window
    sees hours, not passes.
    """
    order = Window.partitionBy("car", "slice").orderBy("clock", "pass_id")
    heads = (
        base.withColumn("rn", F.row_number().over(order))
        .where(F.col("rn") <= depth)
        .groupBy("car", "slice")
        .agg(F.sort_array(F.collect_list(F.struct("clock", "pass_id", "monitor_id"))).alias("head"))
    )
    later = Window.partitionBy("car").orderBy("slice").rowsBetween(1, depth)
    ahead = F.slice(F.flatten(F.collect_list("head").over(later)), 1, depth)
    return (
        heads.select("car", "slice", ahead.alias("ahead"))
        .select("car", "slice", F.explode("ahead").alias("p"))
        .select("car", "p.monitor_id", "p.clock", "p.pass_id", "slice", F.lit(True).alias("lent"))
    )


def prefix_counts(passes: DataFrame, flow: Sequence[str], slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """One row (c1, c2, ...): how often a car passes the first k monitors of ``flow``
    directly one after the other, overlaps included, summed over all cars.

    A car's passes are cut into hours, each with the few passes that follow it, so the
    counts are those of the whole track and no task sees more than one hour of a car.
    """
    depth = len(flow) - 1
    clock = K.clock(F.col("ts"))
    base = passes.select(
        "car", "monitor_id", clock.alias("clock"), "pass_id", F.floor(clock / slice_seconds).alias("slice")
    )
    if depth == 0:
        return base.agg(F.count_if(F.col("monitor_id") == flow[0]).alias("c1"))
    rows = base.withColumn("lent", F.lit(False)).unionByName(_lent(base, depth))
    order = Window.partitionBy("car", "slice").orderBy("clock", "pass_id")
    steps = [F.col("monitor_id") == flow[0]]
    steps += [
        F.coalesce(F.lead("monitor_id", k).over(order) == flow[k], F.lit(False))
        for k in range(1, len(flow))
    ]
    hits = rows.select("lent", *[s.alias(f"s{i}") for i, s in enumerate(steps)]).where(~F.col("lent"))
    return hits.agg(
        *[
            F.count_if(reduce(and_, [F.col(f"s{i}") for i in range(k)])).alias(f"c{k}")
            for k in range(1, len(flow) + 1)
        ]
    )


def conversion(
    passes: DataFrame, flow: Sequence[str], rates_only: bool = False, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """(flow, step, match_count, rate): rate = matches of k monitors / matches of k-1, two
    decimals. It is NULL for the first step and after a step without matches;
    ``rates_only`` leaves those rows out."""
    counts = prefix_counts(passes, flow, slice_seconds)
    steps = [
        F.struct(
            F.lit(",".join(flow[:k])).alias("flow"),
            F.lit(k).alias("step"),
            F.col(f"c{k}").alias("match_count"),
            (F.col(f"c{k - 1}") if k > 1 else F.lit(None).cast("bigint")).alias("before"),
        )
        for k in range(1, len(flow) + 1)
    ]
    rate = round_rate(F.try_divide(F.col("match_count").cast("double"), F.col("before")))
    out = counts.select(F.explode(F.array(*steps)).alias("s")).select(
        "s.flow", "s.step", "s.match_count", F.expr("s.before").alias("before")
    )
    out = out.select("flow", "step", "match_count", rate.alias("rate"))
    return out.where(F.col("rate").isNotNull()) if rates_only else out
