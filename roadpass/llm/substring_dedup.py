"""Removal of word passages that occur in more than one document.

Method: seed and extend. A window is ``window`` consecutive words of one document. Every
window selects one anchor, the run of ``seed_words`` words with the smallest hash inside
it (winnowing), so equal windows select equal anchors. Then

1. anchors found in two or more documents are kept (counts only, nothing is paired);
2. documents are joined with the anchors they share;
3. each shared anchor is extended both ways over all windows that select it. Whole
   extensions are compared first; only one of each different extension, that of its
   smallest document, is compared window by window. Both comparisons take a minimum per
   fingerprint, so a passage shared by n documents costs n rows and never n squared;
4. overlapping repeats of a document join into maximal ones.

A word is removed when a window covers it whose words also start in a document with a
smaller ``doc_id``. Fingerprints have 128 bits.

Edge cases: a null text has no words; a document shorter than a window keeps all words; a
null ``doc_id`` neither removes words elsewhere nor loses any; rows that share a
``doc_id`` are one document (copies of one text; where their texts differ, each row loses
the places found in any of them); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.llm.scratch import release, stored
from roadpass.llm.words import Words, joined, places, slices, window_sums

WINDOW = 13
SEED_WORDS = 5


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, and the removed spans (start, length in words)."""
    ranges = find_repeats(docs, window, seed_words)
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("ranges"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(lists, "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            covered = cover(words.bounds, part.column("ranges"))
            keep = ~covered
            gone = np.concatenate([[0], np.cumsum(covered)])
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array((gone[words.bounds[1:]] - gone[words.bounds[:-1]]).astype(np.int64)),
                    joined(words, keep),
                    maximal(words.bounds, covered),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text", "spans"],
            )

    return rows.mapInArrow(
        cut,
        "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,length:int>>",
    )


def cover(bounds: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Which words the ranges (start, length) of their text cover."""
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    start, length = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
    first = np.minimum(bounds[row] + start, bounds[row + 1])
    last = np.minimum(first + length, bounds[row + 1])
    size = int(bounds[-1]) + 1
    open_ = np.cumsum(np.bincount(first, minlength=size) - np.bincount(last, minlength=size))
    return open_[:-1] > 0


def maximal(bounds: np.ndarray, covered: np.ndarray) -> pa.ListArray:
    """The runs of covered words of each text, as (start, length)."""
    edge = np.zeros(len(covered) + 1, bool)
    edge[bounds] = True
    begins, finishes = covered.copy(), covered.copy()
    begins[1:] &= ~covered[:-1] | edge[1:-1]
    finishes[:-1] &= ~covered[1:] | edge[1:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    row = np.searchsorted(bounds, first, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array((first - bounds[row]).astype(np.int32)), pa.array((last - first).astype(np.int32))], ["start", "length"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, bounds).astype(np.int32)), spans)


def find_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """Ranges (doc_id, start, length in words) whose windows occur in a smaller document.

    The ranges of a document may overlap.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    seeds = texts.mapInArrow(_seeds(window, seed_words), "seed long, doc_id long, pos int")
    shared = stored(
        seeds.groupBy("seed")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("seed"),
        "shared-anchors",
    )
    at = stored(seeds.join(shared, "seed").select("doc_id", "pos"), "anchor-places")
    release(shared)
    by_doc = at.groupBy("doc_id").agg(F.collect_list("pos").alias("pos"))
    extended = stored(
        texts.join(by_doc, "doc_id").mapInArrow(
            _extensions(window, seed_words), "doc_id long, start int, n int, whole1 long, whole2 long"
        ),
        "extensions",
    )
    release(at)
    whole = stored(
        extended.groupBy("whole1", "whole2").agg(F.min("doc_id").alias("first_doc")), "whole-extensions"
    )
    judged = stored(
        extended.join(whole, ["whole1", "whole2"]).select(
            "doc_id", "start", "n", (F.col("doc_id") > F.col("first_doc")).alias("repeated")
        ),
        "judged-extensions",
    )
    release(extended, whole)
    # Every different extension is present in its smallest document, so these rows hold
    # every different window together with the smallest document that has it.
    to_split = judged.where("not repeated").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    single = stored(
        texts.join(to_split, "doc_id").mapInArrow(_windows(window), "doc_id long, start int, w1 long, w2 long"),
        "single-windows",
    )
    first = stored(
        single.groupBy("w1", "w2")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc < last_doc")
        .drop("last_doc"),
        "first-windows",
    )
    late = stored(
        single.join(first, ["w1", "w2"]).where("doc_id > first_doc").select("doc_id", "start", F.lit(window).alias("length")),
        "late-windows",
    )
    release(single, first)
    whole_runs = judged.where("repeated").select("doc_id", "start", (F.col("n") + (window - 1)).alias("length"))
    return whole_runs.unionByName(late)


class _Anchors:
    """The anchors of a slice: word place, and the first and last window that select it."""

    def __init__(self, words: Words, window: int, seed_words: int):
        self.hashes = words.hashes()
        self.window = window
        seeds = window_sums(self.hashes, seed_words, seed=1)
        starts = places(words.bounds, window)
        reach = window - seed_words + 1
        if not len(starts):
            self.place = self.low = self.high = starts
            self.seed, self.row = np.zeros(0, np.uint64), starts
            return
        best, shift = seeds[starts], np.zeros(len(starts), np.int64)
        for j in range(1, reach):
            other = seeds[starts + j]
            better = other <= best
            best = np.where(better, other, best)
            shift[better] = j
        at = starts + shift
        row = np.searchsorted(words.bounds, starts, "right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        self.place, self.seed, self.row = at[first], best[first], row[first]
        self.low, self.high = starts[first], starts[last]


def _seeds(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            found = _Anchors(words, window, seed_words)
            ids = part.column("doc_id").to_numpy()
            yield pa.record_batch(
                [
                    pa.array(found.seed.view(np.int64)),
                    pa.array(ids[found.row]),
                    pa.array((found.place - words.bounds[found.row]).astype(np.int32)),
                ],
                ["seed", "doc_id", "pos"],
            )

    return run


def _extensions(window: int, seed_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            found = _Anchors(words, window, seed_words)
            if not len(found.place):
                continue
            ids = part.column("doc_id").to_numpy()
            lists = part.column("pos")
            wanted = np.repeat(words.bounds[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()
            is_wanted = np.zeros(int(words.bounds[-1]) + 1, bool)
            # A repeated doc_id brings the places of all its texts; those past the end are not this one's.
            is_wanted[np.minimum(wanted, len(is_wanted) - 1)] = True
            keep = is_wanted[found.place]
            low, high, row = found.low[keep], found.high[keep], found.row[keep]
            n = high - low + 1
            place, offset = _spread(low, n)
            whole = []
            # The run of an anchor's windows is hashed window by window.
            for seed in (2, 3):
                codes = window_sums(found.hashes, window, seed)
                factor = np.random.Generator(np.random.PCG64(seed + 3)).integers(0, 2**63, window, dtype=np.uint64)
                terms = codes[place] * (factor[offset] * np.uint64(2) + np.uint64(1))
                sums = np.add.reduceat(terms, np.cumsum(n) - n) if len(n) else terms
                whole.append(pa.array((sums + n.astype(np.uint64)).view(np.int64)))
            yield pa.record_batch(
                [
                    pa.array(ids[row]),
                    pa.array((low - words.bounds[row]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    *whole,
                ],
                ["doc_id", "start", "n", "whole1", "whole2"],
            )

    return run


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first, first + 1, ... of each run of ``n``, and their number in the run."""
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + offset, offset


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            hashes = words.hashes()
            lists = part.column("runs")
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            starts, n = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
            # A repeated doc_id brings the runs of all its texts; those past the end are not this one's.
            fits = starts + n + window - 1 <= words.counts[row]
            row, starts, n = row[fits], starts[fits], n[fits]
            place, offset = _spread(words.bounds[row] + starts, n)
            codes = [window_sums(hashes, window, s).view(np.int64) for s in (2, 3)]
            yield pa.record_batch(
                [
                    pa.array(np.repeat(part.column("doc_id").to_numpy()[row], n)),
                    pa.array((np.repeat(starts, n) + offset).astype(np.int32)),
                    *(pa.array(c[place] if len(place) else np.zeros(0, np.int64)) for c in codes),
                ],
                ["doc_id", "start", "w1", "w2"],
            )

    return run
