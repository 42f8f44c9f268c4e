"""Importance resampling of documents towards a target distribution.

Features are all runs of 1 to ``widest`` consecutive words; a feature's bucket is the CRC-32
of its bytes modulo ``buckets`` (see ``crc``). Two counts over all documents and all target
texts give every bucket a gain, the logarithm of target over documents with one added to each
bucket; a document's weight is the sum of its features' gains. A Gumbel value made from the
document's id is added, and the highest scores are drawn: that draws without replacement with
chances in proportion to exp(weight / 1000).

Counts are summed inside the tasks first, so at most ``buckets`` rows leave a task and
reach the driver. Ranks come from ranges of scores and the ranges' sizes, not from one sort.

Edge cases: null and empty texts, and texts without words, have no features and weight 0; the
id of a null ``doc_id`` is hashed as empty text and sorts after the others; repeated rows are
drawn each; equal scores go to the smaller ``doc_id``, then to the fewer features; without
target texts every bucket counts as unseen there; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpass.llm.crc import crc32
from roadpass.llm.positions import positions
from roadpass.llm.scratch import release, stored
from roadpass.llm.words import Words, places, slices

BUCKETS = 10_000
SEED = 2024
# Bytes that no word holds: ASCII but for digits and lower-case letters.
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[:128] = True
_OUTSIDE[0x30:0x3A] = _OUTSIDE[0x61:0x7B] = False


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, widest: int = 1, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gains = _gains(_counts(texts.select("text"), widest, buckets), _counts(target.select("text"), widest, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"), lower=True, outside=_OUTSIDE)
            features, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for rows, bucket in _features(words, widest, buckets):
                features += np.bincount(rows, minlength=part.num_rows)
                np.add.at(weight, rows, gains[bucket])
            counted = [pa.array(x.astype(np.int64)) for x in (words.counts, features, weight)]
            yield pa.record_batch([part.column("doc_id"), *counted], ["doc_id", "n_words", "n_features", "weight"])

    weighed = texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored-documents")
    able = F.col("n_words") >= min_words
    drawn = percent * scored.where(able).count() // 100
    placed = positions(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    ranked = placed.withColumn("rank", F.when(F.col("position") < drawn, F.col("position") + 1)).drop("position")
    out = stored(ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))), "resampled")
    release(scored, placed)
    return out


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a standard Gumbel value made from the id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _features(words: Words, widest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width, the row and the bucket of every run of so many words."""
    data, starts, ends, rows = words.data, words.starts, words.ends, words.rows
    if widest > 1:
        # Words side by side with one space between, whatever stood there.
        lengths = ends - starts
        ends = np.cumsum(lengths + 1) - 1
        moved = ends - lengths
        at = np.arange(int(ends[-1]) + 1 if len(ends) else 0) + np.repeat(starts - moved, lengths + 1)
        data = data[np.minimum(at, max(len(data) - 1, 0))]
        data[ends] = 0x20
        starts = moved
    for width in range(1, widest + 1):
        first = places(words.bounds, width)
        yield rows[first], crc32(data, starts[first], ends[first + width - 1]) % np.uint32(buckets)


def _counts(texts: DataFrame, widest: int, buckets: int) -> np.ndarray:
    """How many features each bucket holds; one row a bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for _, bucket in _features(Words(part.column("text"), lower=True, outside=_OUTSIDE), widest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    m = len(source)
    s_all, t_all = float(source.sum() + m), float(target.sum() + m)
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)
