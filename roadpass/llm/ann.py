"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

Largest inner product is turned into smallest distance: a candidate gets one more component
``sqrt(M^2 - |x|^2)`` with M the largest norm of all vectors, a query gets 0 there. The
space is then rotated at random, and

1. a k-means of a bounded sample (``SAMPLE`` rows, smallest hashes of their ids) gives the
   lists; every row is assigned to its nearest centre;
2. the number of lists to probe is calibrated on the sample: as many as hold ``RECALL`` of
   the sample's own nearest neighbours, and at least enough for k candidates; lists that
   hold a query's nearest rows of the sample are probed as well;
3. lists are cut into blocks and each pair of a query block and a candidate block of one
   list is a cell, so a list of any size is spread;
4. in a cell, rotated components are scanned in blocks of columns. After d of D components a
   candidate is abandoned when its partial distance shows, by the test of a random
   projection, that its whole distance exceeds the query's limit. The limit is at
   first the distance within which the sample suggests 4k of all candidates, and falls
   with the candidates found;
5. survivors get the exact inner product of the original vectors;
6. a query that ends with fewer than k rows, though there are more candidates, is scanned once
   more over all lists without a limit.

Edge cases: see ``vectors.usable`` for rows that take no part (zero vectors too); rows that
share a query's ``vec_id`` are not its candidates, other repeated rows are candidates each;
equal scores go to the smaller ``vec_id``; fewer than k candidates give all; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.llm.scratch import release, stored
from roadpass.llm.vectors import best, kept, matrix, queries_of, usable

SAMPLE = 8192
MAX_LISTS = 1024
RECALL = 0.96
BLOCK = 4096
COLUMNS = 16
# Confidence of the hypothesis test, in standard deviations of a random projection.
EPSILON = 2.1


def nearest(rows: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score for every query."""
    whole = stored(usable(rows, nonzero=True), "vectors")
    facts = whole.agg(
        F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")
    ).first()
    queries = queries_of(whole, every)
    if not facts["n"]:
        return best(queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")), k)
    chosen = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample, ids = np.array([r["vec"] for r in chosen]), np.array([r["vec_id"] for r in chosen])
    index = Index(sample, ids, facts["norm2"], min(MAX_LISTS, int(np.ceil(np.sqrt(facts["n"])))), k)
    listed = stored(whole.mapInArrow(_assign(index), "list int, vec_id long, vec array<double>"), "listed-vectors")
    # One row per list, MAX_LISTS at most.
    sizes = listed.groupBy("list").agg(F.count("*").alias("rows"))
    counts = {r["list"]: r["rows"] for r in sizes.collect()}
    index.sizes = np.array([counts.get(i, 0) for i in range(len(index.centres))])
    top = stored(best(_scanned(index, queries, listed, sizes, every_list=False), k), "nearest")
    # Limits come from a sample, so a query may end with too few; it asks once more without them.
    own = whole.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("own"))
    have = top.groupBy("query_id").agg(F.count("*").alias("have"))
    room = F.least(F.lit(k), F.lit(facts["n"]) - F.col("own"))
    short = stored(
        own.join(have, "query_id", "left").where(F.coalesce("have", F.lit(0)) < room).select("query_id"), "short-queries"
    )
    if short.isEmpty():
        release(whole, listed, short)
        return top
    again = best(_scanned(index, queries.join(short, "query_id", "left_semi"), listed, sizes, every_list=True), k)
    out = stored(top.join(short, "query_id", "left_anti").unionByName(again), "all-nearest")
    release(whole, listed, short, top)
    return out


def _scanned(index: Index, queries: DataFrame, listed: DataFrame, sizes: DataFrame, every_list: bool) -> DataFrame:
    """(query_id, vec_id, score): the best rows of every cell of a query block and a block of a list."""
    asked = stored(queries.mapInArrow(_probe(index, every_list), "list int, query_id long, vec array<double>, bound double"), "probes")
    asking = asked.groupBy("list").agg(F.count("*").alias("queries"))
    blocks = F.broadcast(
        sizes.join(asking, "list").select(
            "list",
            F.ceil(F.col("rows") / BLOCK).cast("int").alias("nc"),
            F.ceil(F.col("queries") / BLOCK).cast("int").alias("nq"),
        )
    )
    left = asked.join(blocks, "list").select(
        "list",
        F.pmod(F.xxhash64("query_id"), "nq").cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb"),
        "query_id", "vec", "bound",
    )
    right = listed.join(blocks, "list").select(
        "list",
        F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"),
        F.pmod(F.xxhash64("vec_id", "vec"), "nc").cast("int").alias("cb"),
        "vec_id", "vec",
    )
    cell = ["list", "qb", "cb"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        _scan(index.rotation, index.norm2, index.k), "query_id long, vec_id long, score double"
    )


class Index:
    """Centres, rotation and calibration; a few MB, whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, norm2: float, lists: int, k: int):
        self.norm2, self.ids = norm2, ids
        rng = np.random.default_rng(7)
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.sample = sample
        points = lifted(sample, norm2)
        self.centres = k_means(points, min(lists, len(points)), rng)
        self.home = np.argmin(distances(points, self.centres), axis=1)
        self.sizes = np.zeros(len(self.centres), np.int64)
        self.k = k
        self.probes = self._calibrate(points, rng)

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Lists from near to far for queries with a last component 0."""
        flat = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        return np.argsort(distances(flat, self.centres), axis=1, kind="stable")

    def _calibrate(self, points: np.ndarray, rng: np.random.Generator) -> int:
        ask = rng.choice(len(points), min(512, len(points)), replace=False)
        score = self.sample[ask] @ self.sample.T
        score[self.ids[ask][:, None] == self.ids[None, :]] = -np.inf
        near = np.argsort(-score, axis=1)[:, : min(self.k, len(points) - 1)]
        if not near.size:
            return len(self.centres)
        home = self.home
        place = np.argsort(self.order(self.sample[ask]), axis=1)
        needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel()) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))])


def lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, norm2 - np.einsum("ij,ij->i", vectors, vectors)))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)


def k_means(points: np.ndarray, lists: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = points[rng.choice(len(points), lists, replace=False)].copy()
    for _ in range(rounds):
        home = np.argmin(distances(points, centres), axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, points)
        count = np.bincount(home, minlength=lists)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _assign(index: Index):
    centres, norm2 = index.centres, index.norm2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = np.argmin(distances(lifted(matrix(batch.column("vec")), norm2), centres), axis=1)
                yield pa.record_batch([pa.array(home.astype(np.int32)), batch.column("vec_id"), batch.column("vec")], ["list", "vec_id", "vec"])

    return run


def _probe(index: Index, every_list: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = lifted(index.sample, index.norm2)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                q = matrix(batch.column("vec"))
                order = index.order(q)
                enough = (np.cumsum(index.sizes[order], axis=1) < index.k + 1).sum(axis=1) + 1
                count = np.minimum(np.maximum(index.probes, enough), order.shape[1])
                if every_list:
                    count[:] = order.shape[1]
                probed = np.zeros(order.shape, bool)
                np.put_along_axis(probed, order, np.arange(order.shape[1])[None, :] < count[:, None], axis=1)
                # Lists that hold the sample's nearest are probed however far their centres are.
                flat = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
                away = distances(flat, points)
                # Rows of the query's own id are no candidates, however many the sample holds.
                away[batch.column("query_id").to_numpy()[:, None] == index.ids[None, :]] = np.inf
                near = np.argpartition(away, min(index.k, len(points) - 1), axis=1)[:, : index.k + 1]
                np.put_along_axis(probed, index.home[near], True, axis=1)
                # A limit that about 4k of the candidates in these lists keep, so that wrong tests
                # seldom leave a query with too few.
                bound = np.full(len(q), np.inf)
                far = max(8, -(-4 * index.k * len(points) // int(index.sizes.sum())))
                if len(points) > far and not every_list:
                    away[~probed[:, index.home]] = np.inf
                    bound = np.partition(away, far, axis=1)[:, far]
                row, chosen = np.nonzero(probed)
                # A list without rows has no cell.
                some = index.sizes[chosen] > 0
                row, chosen = row[some], chosen[some]
                yield pa.record_batch(
                    [
                        pa.array(chosen.astype(np.int32)),
                        batch.column("query_id").take(pa.array(row)),
                        batch.column("vec").take(pa.array(row)),
                        pa.array(bound[row]),
                    ],
                    ["list", "query_id", "vec", "bound"],
                )

    return run


def _scan(rotation: np.ndarray, norm2: float, k: int):
    def run(left, right):
        queries, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        q, c = matrix(left.column("vec")), matrix(right.column("vec"))
        if not len(q) or not len(c):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rq = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ rotation
        rc = lifted(c, norm2) @ rotation
        width, limit = rq.shape[1], left.column("bound").to_numpy().copy()
        length2 = np.einsum("ij,ij->i", q, q)
        got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for at in range(0, len(c), 512):
            part = slice(at, at + 512)
            x, y = np.nonzero(queries[:, None] != ids[None, part])
            partial = np.zeros(len(x))
            for a in range(0, width, COLUMNS):
                b = min(width, a + COLUMNS)
                if len(x) * 4 > len(q) * 512:
                    step = distances(rq[:, a:b], rc[part, a:b])[x, y]
                else:
                    gap = rq[x, a:b] - rc[part][y, a:b]
                    step = np.einsum("ij,ij->i", gap, gap)
                partial += step
                # All components seen: the comparison is exact but for rounding.
                room = (1 + EPSILON / np.sqrt(b)) ** 2 * b / width if b < width else 1 + 1e-9
                alive = partial <= limit[x] * room + 1e-12
                x, y, partial = x[alive], y[alive], partial[alive]
            score = products(q, c[part], x, y)
            got = [np.concatenate(p) for p in zip(got, (x, ids[part][y], score), strict=True)]
            top = kept(got[2], got[1], got[0], k)
            got = [g[top] for g in got]
            full = np.bincount(got[0], minlength=len(q)) == k
            worst = np.full(len(q), np.inf)
            np.minimum.at(worst, got[0], got[2])
            limit[full] = np.minimum(limit, length2 + norm2 - 2 * worst)[full]
        return pa.table({"query_id": queries[got[0]], "vec_id": got[1], "score": got[2]})

    return run


def products(q: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (x, y), summed in the order of components."""
    out = np.zeros(len(x))
    for j in range(q.shape[1]):
        out += q[x, j] * c[y, j]
    return out
