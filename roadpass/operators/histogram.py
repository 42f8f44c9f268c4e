"""Per-value count histogram rendered as ``v=n|v=n``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n)"""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def parse_partials(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Read plain values or ``v=n|v=n`` partial results back as (keys, value, n)."""
    piece = df.select(*keys, F.explode(F.split(column, r"\|")).alias("piece")).where(F.col("piece") != "")
    fields = F.split("piece", "=")
    return piece.select(
        *keys,
        F.get(fields, F.lit(0)).alias("value"),
        F.coalesce(F.get(fields, F.lit(1)).try_cast("bigint"), F.lit(1)).alias("n"),
    )


def render(counts: DataFrame, keys: Sequence[str], value: str, out: str, total: str) -> DataFrame:
    """Fold counts to one row per key: histogram text in value order and the total.

    Each list holds one entry per distinct value, never one per input row.
    """
    merged = counts.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    return merged.groupBy(*keys).agg(
        F.sum("n").alias(total), histogram_text(F.collect_list(F.struct(value, "n")), value).alias(out)
    )


def histogram_text(pairs: Column, value: str) -> Column:
    entries = F.transform(
        F.sort_array(pairs), lambda p: F.concat(p[value], F.lit("="), p["n"].cast("string"))
    )
    return F.array_join(entries, "|")


def group_concat_counts(df: DataFrame, keys: Sequence[str], value: str, out: str, total: str) -> DataFrame:
    """Count histogram of ``value`` per key, from plain values or partial histograms."""
    return render(parse_partials(df, keys, value), keys, "value", out, total)
