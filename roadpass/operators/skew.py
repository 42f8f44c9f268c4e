"""Small helpers against skew that the operators share.

Counts, sums and maxima are protected by Spark's map-side combine. Operators that need
rows together group them by a rule that does not depend on how many there are: tracks by
car and day, ranges by monitor and five minutes, row-to-row comparisons by car and hour
with the next rows lent from the following hours (``funnel``). Aggregates whose buffers
grow with their rows, such as sets, are salted at their hot keys (``salted_aggregate``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
# Counters of the frequent-items sketch; keys below a share of about 1 / WIDTH may be missed.
WIDTH = 4096
# Rows that one task should meet of a key, about.
TARGET_ROWS = 1_000_000
MAX_SALTS = 512


def bounded_broadcast(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast hint only when the caller states a row bound; otherwise the
    join strategy is left to Catalyst's size estimates and adaptive execution. A frame that
    breaks its bound is an error when it is read."""
    if max_rows is None or max_rows > BROADCAST_ROWS:
        return df
    # One row beyond the bound is let through to be noticed, and the few rows are numbered
    # from 0 in one partition.
    message = F.lit(f"more rows than the stated bound of {max_rows}")
    within = F.when(F.monotonically_increasing_id() < max_rows, True).otherwise(F.raise_error(message).cast("boolean"))
    return F.broadcast(df.limit(max_rows + 1).coalesce(1).where(within))


def joined_text(points: str | Column, render, sep: str) -> Column:
    return F.array_join(F.transform(points, render), sep)


def salted_count(df: DataFrame, keys: Sequence[str], value: str, salts: int = 10) -> DataFrame:
    """Two-phase count: spread every key over ``salts`` sub-keys, count there, then
    strip the salt and add up. Returns (keys, value, n), equal to the plain count."""
    salted = df.select(*keys, value, F.pmod(F.xxhash64("pass_id"), F.lit(salts)).alias("salt"))
    partial = salted.groupBy(*keys, value, "salt").agg(F.count("*").alias("n"))
    return partial.groupBy(*keys, value).agg(F.sum("n").alias("n"))


def hot_keys(df: DataFrame, keys: Sequence[str], target_rows: int = TARGET_ROWS, width: int = WIDTH) -> dict[int, int]:
    """Number of salts for each key that holds more than ``target_rows`` rows, by its hash.

    A frequent-items sketch of ``width`` counters finds them in one pass with bounded memory,
    and no more than ``width`` entries reach the driver. Its counts may be off by the rows
    over ``width``, and hashes may coincide: both change how a key is spread, never a result.
    """
    items = df.select(F.xxhash64(*keys).alias("h")).agg(F.expr(f"approx_top_k(h, {width // 2}, {width})").alias("top")).first()["top"]
    found = {r["item"]: r["count"] for r in items or [] if r["count"] > target_rows}
    return {h: min(MAX_SALTS, -(-n // target_rows)) for h, n in found.items()}


# A partial aggregate, and how its values under a name merge.
Mergeable = tuple[Column, Callable[[str], Column]]


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    aggregates: Mapping[str, Mergeable],
    target_rows: int = TARGET_ROWS,
    width: int = WIDTH,
) -> DataFrame:
    """(keys, aggregates), salting hot keys only: their rows are dealt to sub-keys by a hash of
    ``spread_by``, aggregated there, and the parts are merged. Other keys have one part.

    The result equals the plain aggregation whatever the sketch finds.
    """
    hot = hot_keys(df, keys, target_rows, width)
    salt = F.lit(0)
    if hot:
        salts = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
        count = F.coalesce(F.try_element_at(salts, F.xxhash64(*keys)), F.lit(1))
        salt = F.pmod(F.xxhash64(*spread_by), count).cast("int")
    parts = df.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*(part.alias(name) for name, (part, _) in aggregates.items()))
    return parts.groupBy(*keys).agg(*(merge(name).alias(name) for name, (_, merge) in aggregates.items()))
