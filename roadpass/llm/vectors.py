"""Shared parts of the two vector searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, vec) of the rows that can take part, as arrays of double.

    Left out are null ids, null and empty vectors, vectors with null or non-finite
    components and, on request, zero vectors. Vectors must share one length; those of
    another length than the most common one (the larger of two as common) are left out.
    """
    vec = F.col("embedding").cast("array<double>")
    ok = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(
        "vec_id is not null and vec is not null and size(vec) > 0"
        " and forall(vec, x -> x is not null and abs(x) < double('infinity'))"
    )
    if nonzero:
        ok = ok.where("exists(vec, x -> x <> 0)")
    common = ok.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return ok.where(F.size("vec") == (common["d"] if common else 0))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, vec) of ids divisible by ``every``; of rows that share an id the smallest vector asks."""
    return (
        rows.where(F.col("vec_id") % every == 0)
        .groupBy(F.col("vec_id").alias("query_id"))
        .agg(F.min("vec").alias("vec"))
    )


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy().reshape(len(column), -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def kept(scores: np.ndarray, ids: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner, ties to the smaller id."""
    order = np.lexsort((ids, -scores, owner))
    first = np.searchsorted(owner[order], owner[order], "left")
    return order[np.arange(len(order)) - first < k]
