"""Places of rows in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpass.llm.scratch import release, stored

# monotonically_increasing_id keeps the row's place within its partition in the lower bits.
_PLACE_BITS = 33


def positions(table: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``position``: 0, 1, 2, ... by ``order``, over a table read from files.

    Rows are dealt by ranges of the order, numbered inside their range, and the sizes of the
    ranges (one row a shuffle partition) are summed up. Equal rows are told apart by their
    place in the files, so that a key of any frequency is spread.
    """
    dealt = table.withColumn("_at", F.monotonically_increasing_id())
    by = [*order, F.col("_at")]
    sorted_ = dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("_at")
    numbered = stored(sorted_.withColumn("_row", F.monotonically_increasing_id()), "ordered-rows")
    part = F.shiftright("_row", _PLACE_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        numbered.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")),
        "range-starts",
    )
    placed = stored(
        numbered.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + F.col("_row").bitwiseAND((1 << _PLACE_BITS) - 1))
        .drop("_part", "_start", "_row"),
        "placed-rows",
    )
    release(numbered, starts)
    return placed
