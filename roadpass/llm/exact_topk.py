"""Exact top-k search by integer inner product with multi-resolution segment statistics.

Components become ``floor(256 * x)``. Vectors are cut into segments of 16, then 4, then 2
components, and each segment is described by its mean and deviation. For segments of length
l with means m and deviations s,

    squared distance >= sum l * ((m - m')^2 + (s - s')^2),

so the inner product is at most ``sum l * (m m' + s s')``. Coarse bounds come first; only
pairs that may still enter a query's k best go to the next level, and the survivors' exact
integer products are computed. Nothing is approximate.

Queries and candidates are dealt to blocks, and every pair of a query block and a candidate
block is one cell, so a task holds two blocks whatever the tables' sizes. A cell keeps k
rows per query.

Edge cases: see ``vectors.usable`` for rows that take no part; rows that share a query's
``vec_id`` are not its candidates, other repeated rows are candidates each; equal scores go
to the smaller ``vec_id``; fewer than k candidates give all; an empty table gives an empty
result; other columns are ignored. Scores must fit in a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.llm.scratch import stored
from roadpass.llm.vectors import best, kept, matrix, queries_of, usable

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
SEGMENTS = (16, 4, 2)


def exact_topk(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score for every query."""
    whole = usable(rows).withColumn("vec", F.transform("vec", lambda x: F.floor(256 * x).cast("long")))
    whole = stored(whole, "integer-vectors")
    queries = stored(queries_of(whole, every), "queries")
    nq, nc = (max(1, -(-t.count() // size)) for t, size in ((queries, QUERY_BLOCK), (whole, CANDIDATE_BLOCK)))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))
    )
    # A salt of the vector spreads rows that share an id.
    right = whole.withColumn("cb", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(nc)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))
    )

    def searched(asking: DataFrame, candidates: DataFrame) -> DataFrame:
        cells = asking.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb"))
        return best(cells.applyInArrow(_search(k), "query_id long, vec_id long, score long"), k)

    floor = F.lit(None).cast("long")
    if nc > 1:
        # The k-th score of one block of candidates is a floor for all the others.
        first = searched(left.where("cb = 0").withColumn("floor", floor), right.where("cb = 0"))
        floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        left = left.join(stored(floors, "floors"), "query_id", "left")
    else:
        left = left.withColumn("floor", floor)
    return searched(left, right)


def statistics(vectors: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that their product bounds the inner product."""
    n, d = vectors.shape
    padded = np.zeros((n, -(-d // length) * length))
    padded[:, :d] = vectors
    parts = padded.reshape(n, -1, length)
    return np.sqrt(length) * np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1)


def _search(k: int):
    def run(left, right):
        queries, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        q, c = matrix(left.column("vec")), matrix(right.column("vec"))
        if not len(q) or not len(c):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        levels = [(statistics(q, s), statistics(c, s)) for s in SEGMENTS]
        floor = left.column("floor").to_numpy(zero_copy_only=False).astype(float)
        floor = np.where(np.isnan(floor), -np.inf, floor)
        got = [np.zeros(0, np.int64)] * 3
        for at in range(0, len(c), 1024):
            part = slice(at, at + 1024)
            alive = queries[:, None] != ids[None, part]
            for qs, cs in levels:
                who, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                bound = qs[who] @ cs[part][cols].T
                # Room for rounding in the statistics.
                slack = 1e-9 * (1 + np.abs(bound))
                alive[np.ix_(who, cols)] &= bound + slack >= floor[who][:, None]
            x, y = np.nonzero(alive)
            score = integer_products(q, c[part], x, y)
            got = [np.concatenate(p) for p in zip(got, (x, ids[part][y], score), strict=True)]
            top = kept(got[2], got[1], got[0], k)
            got = [g[top] for g in got]
            full = np.flatnonzero(np.bincount(got[0], minlength=len(q)) == k)
            lowest = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(lowest, got[0], got[2])
            floor[full] = np.maximum(floor, lowest)[full]
        return pa.table({"query_id": queries[got[0]], "vec_id": got[1], "score": got[2]})

    return run


def integer_products(q: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact products of the pairs (x, y), component by component."""
    out = np.zeros(len(x), np.int64)
    for j in range(q.shape[1]):
        out += q[x, j] * c[y, j]
    return out
