"""Row numbers within a class of rows, however large the class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpass.llm.scratch import release, stored


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... within equal ``keys``, which must not be null.

    A class of n rows is dealt by a hash of ``order`` to about sqrt(n) chunks of about
    sqrt(n) rows; rows are numbered inside their chunk and the chunks' counts are summed
    up, so no task handles a whole class. The numbers depend on the rows only, not on how
    they are partitioned; rows equal in ``order`` are interchangeable.
    """
    sizes = stored(df.groupBy(*keys).agg(F.count("*").alias("_rows")), "class-sizes")
    chunk = F.pmod(F.xxhash64(*order), F.ceil(F.sqrt("_rows")).cast("long"))
    dealt = df.join(sizes, keys).withColumn("_chunk", chunk).drop("_rows").repartition(*keys, "_chunk")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = stored(dealt.withColumn("_inside", F.row_number().over(inside).cast("long") - 1), "numbered-rows")
    release(sizes)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = stored(
        numbered.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n"),
        "chunk-starts",
    )
    return (
        numbered.join(chunks, [*keys, "_chunk"])
        .withColumn("rank", F.col("_before") + F.col("_inside"))
        .drop("_chunk", "_inside", "_before")
    )
