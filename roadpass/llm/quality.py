"""A quality classifier trained from weak labels.

1. Heuristic labellers vote on every document: bad, good or no opinion. One family looks
   for junk (symbols, capitals, repeated words, little variety, tables) and one for abuse
   (three word lists, each a third of the words that labelled documents show as typical).
   The given labels vote in their family too, as one labeller among the others.
2. Expectation-maximisation estimates each labeller's accuracy and every vote pattern's
   posterior. Patterns and their numbers of documents are a complete summary of all
   documents, of at most 3^6 rows a family.
3. Posteriors of a bounded sample train a linear scorer over hashed words and text measures.
4. The scorer, a few thousand weights, runs over every text in one pass.

Bounds: ``LABELLED`` labelled documents for the word lists, ``SAMPLE`` documents for the
scorer, both chosen by a hash of their ids; ``FEATURES`` hashed words. Votes, patterns and
scores cover all documents.

Edge cases: an empty or null text carries no evidence and is kept; a null ``doc_id`` or one
without labels is scored like any other; repeated rows are scored each; without labels the
abuse family has no word lists and no say; an empty table gives an empty result; other
columns pass through ``keep`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.llm.scratch import release, stored
from roadpass.llm.words import Words, slices, span_hashes

LABELLED = 20_000
SAMPLE = 20_000
FEATURES = 4096
LEXICON = 3000
ROUNDS = 200

JUNK, ABUSE = ("symbols", "capitals", "repeats", "variety", "tables"), ("list_a", "list_b", "list_c")
MEASURES = ("symbols", "capitals", "repeats", "sameness", "tables")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"!#$%&*|=<>^~_{}[]\\")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_EDGE = np.zeros(256, bool)
_EDGE[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_PIPE = 0x7C


class Measured:
    """Measures of a slice of texts and the hashes of their plain words."""

    def __init__(self, column: pa.Array):
        words = Words(column, lower=False)
        n = len(words.bounds) - 1
        data, rows, counts = words.data, words.rows, np.maximum(words.counts, 1)
        lowered = np.where(_CAPITAL[data], data + 32, data).astype(np.uint8)
        a, b = stripped(data, words.starts, words.ends)
        self.hashes, self.rows, self.words = span_hashes(lowered, a, b), rows, words.counts

        def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return (total[words.offsets[1:]] - total[words.offsets[:-1]]) / np.maximum(of, 1)

        size = np.diff(words.offsets)
        letters = share(_LETTER[data], 1) if len(data) else np.zeros(n)
        again = np.zeros(len(rows), bool)
        again[1:] = (self.hashes[1:] == self.hashes[:-1]) & (rows[1:] == rows[:-1])
        order = np.lexsort((self.hashes, rows))
        new = np.ones(len(rows), bool)
        new[1:] = (self.hashes[order][1:] != self.hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        self.distinct = order[new]
        different = np.bincount(rows[self.distinct], minlength=n)
        pipes = (data[words.starts] == _PIPE) & (words.ends - words.starts == 1) if len(rows) else again
        self.measures = np.stack(
            [
                share(_SYMBOL[data], size),
                share(_CAPITAL[data], letters),
                np.bincount(rows, again, n) / counts,
                1 - different / counts,
                np.bincount(rows, pipes, n) / counts,
            ],
            axis=1,
        )

    def votes(self) -> np.ndarray:
        """1 bad, 2 good, 0 no opinion, for the junk labellers."""
        symbols, capitals, repeats, sameness, tables = self.measures.T
        some, many = self.words >= 3, self.words >= 40
        vote = lambda bad, good: np.where(bad & some, 1, np.where(good & some, 2, 0))
        return np.stack(
            [
                vote(symbols > 0.05, symbols < 0.01),
                vote(capitals > 0.35, capitals < 0.15),
                vote(repeats > 0.2, repeats < 0.08),
                vote(many & (sameness > 0.85), many & (sameness < 0.6)),
                vote(tables > 0.1, np.zeros(len(tables), bool)),
            ],
            axis=1,
        )

    def holds(self, listed: np.ndarray) -> np.ndarray:
        """Whether each text has a word of a sorted list of hashes."""
        hit = np.zeros(len(self.words), bool)
        if len(listed):
            hit[self.rows[found(self.hashes, listed)[0]]] = True
        return hit


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without ASCII punctuation at either end; a span of nothing else stays whole."""
    a, b = starts.copy(), ends.copy()
    for _ in range(3):
        long = b - a > 1
        a = a + (long & _EDGE[data[a]]) if len(a) else a
        long = b - a > 1
        b = b - (long & _EDGE[data[b - 1]]) if len(b) else b
    return a, b


def found(hashes: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are listed (a mask), and the place of each in the list."""
    at = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
    return listed[at] == hashes, at


class Scorer:
    """A linear scorer over measures and hashed words."""

    def __init__(self, listed: np.ndarray, weights: np.ndarray):
        self.listed, self.weights = listed, weights

    def probability(self, m: Measured) -> np.ndarray:
        k = len(MEASURES) + 1
        score = dense(m) @ self.weights[:k]
        if len(self.listed):
            hit, at = found(m.hashes[m.distinct], self.listed)
            score += np.bincount(m.rows[m.distinct][hit], self.weights[k:][at[hit]], len(score))
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score (probability of being bad) and rejected."""
        listed = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                m = Measured(part.column("text"))
                p = listed.probability(m)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(p), pa.array((p >= 0.5) & (m.words > 0))], ["doc_id", "score", "rejected"]
                )

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return texts.mapInArrow(run, "doc_id long, score double, rejected boolean")

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are not rejected, with all their columns."""
        scorer = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                m = Measured(part.column("text"))
                bad = (scorer.probability(m) >= 0.5) & (m.words > 0)
                yield part.filter(pa.array(~bad))

        return docs.mapInArrow(run, docs.schema)


def dense(m: Measured) -> np.ndarray:
    """Measures, saturated where more of the same says nothing new, and a constant."""
    full = np.array([0.1, 0.4, 0.3, 1.0, 0.2])
    return np.concatenate([np.minimum(m.measures / full, 1), np.ones((len(m.words), 1))], axis=1)


def sampled(rows: DataFrame, size: int, total: int) -> DataFrame:
    """About ``size`` of ``total`` rows, those whose ids hash lowest."""
    share = min(1.0, size / max(total, 1))
    return rows.where(F.xxhash64("doc_id") <= F.lit(int((share - 0.5) * 2**64 * (1 - 1e-12))).cast("long") if share < 1 else F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = stored(
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic")),
        "labels",
    )
    lists = _word_lists(texts, known)
    votes = stored(texts.mapInArrow(_vote(lists), "doc_id long, junk int, abuse int"), "votes")
    judged = votes.join(known, "doc_id", "left").select(
        "doc_id",
        (F.col("junk") * 3 + F.expr("case quality when 0 then 1 when 1 then 2 else 0 end")).alias("junk"),
        (F.col("abuse") * 3 + F.expr("case toxic when 1 then 1 when 0 then 2 else 0 end")).alias("abuse"),
    )
    judged = stored(judged, "vote-patterns")
    posterior = {}
    for family, size in (("junk", len(JUNK) + 1), ("abuse", len(ABUSE) + 1)):
        counts = {r[0]: r[1] for r in judged.groupBy(family).count().collect()}
        posterior[family] = expectation_maximisation(counts, size)
    total = votes.count()
    # About SAMPLE ids and patterns.
    picked = F.broadcast(sampled(judged.where("doc_id is not null"), SAMPLE, total).dropDuplicates(["doc_id"]))
    table = sampled(texts, SAMPLE, total).join(picked, "doc_id")
    scorer = _train(table, posterior)
    release(known, votes, judged)
    return scorer


def _word_lists(texts: DataFrame, known: DataFrame) -> list[np.ndarray]:
    """Words typical of documents labelled toxic, in three lists by hash."""
    some = F.broadcast(sampled(known.where("toxic is not null"), LABELLED, known.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            m = Measured(part.column("text"))
            toxic = part.column("toxic").to_numpy()[m.rows[m.distinct]]
            yield pa.record_batch([pa.array(m.hashes[m.distinct].view(np.int64)), pa.array(toxic.astype(np.int64))], ["word", "toxic"])

    rows = (
        texts.join(some, "doc_id")
        .groupBy("text")
        .agg(F.max("toxic").alias("toxic"))
        .mapInArrow(run, "word long, toxic long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
        # Nine of ten documents with the word are toxic, and they are several.
        .where("bad >= 4 and bad >= 0.9 * n")
        .orderBy(F.desc("bad"), "word")
        .limit(LEXICON)
        .collect()
    )
    words = np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))
    return [words[words % np.uint64(3) == np.uint64(i)] for i in range(3)]


def _vote(lists: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            m = Measured(part.column("text"))
            abuse = np.stack([np.where(m.holds(x), 1, 2) if len(x) else np.zeros(len(m.words), np.int64) for x in lists], axis=1)
            code = lambda v: pa.array((v @ 3 ** np.arange(v.shape[1])[::-1]).astype(np.int32))
            yield pa.record_batch([part.column("doc_id"), code(m.votes()), code(abuse)], ["doc_id", "junk", "abuse"])

    return run


def expectation_maximisation(counts: dict[int, int], labellers: int, rounds: int = ROUNDS) -> dict[int, float]:
    """The posterior of being bad of each vote pattern.

    ``counts`` maps a pattern (votes as digits of base 3) to its number of documents. Every
    labeller has a table of vote probabilities for each of the two classes.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes.tolist()], np.float64)
    votes = codes[:, None] // 3 ** np.arange(labellers)[::-1] % 3
    bad, good = (votes == 1).sum(axis=1), (votes == 2).sum(axis=1)
    # To start with, any complaint weighs more than approval.
    p = (0.5 * (bad == 0) * 0.1 + (bad > 0) * (2 * bad + 0.5) / (2 * bad + 0.5 * good + 1)).clip(0.01, 0.99)
    for _ in range(rounds):
        prior = (n @ p + 1) / (n.sum() + 2)
        log = np.tile(np.log([1 - prior, prior]), (len(codes), 1))
        for k in range(labellers):
            for c, weight in enumerate((n * (1 - p), n * p)):
                seen = np.bincount(votes[:, k], weight, 3) + 0.1
                log[:, c] += np.log(seen / seen.sum())[votes[:, k]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        done = np.abs(new - p).max() < 1e-7
        p = new
        if done:
            break
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def _train(table: DataFrame, posterior: dict[str, dict[int, float]]) -> Scorer:
    """Fit on at most about ``SAMPLE`` documents.

    Words are counted on the executors; the driver gets the chosen ones, and for each
    document its measures and which chosen words it has.
    """
    # Of equal texts the one with the smallest id counts, so that reruns agree.
    first = table.groupBy("text").agg(F.min(F.struct("doc_id", "junk", "abuse")).alias("first"))
    table = stored(first.select("text", "first.*"), "scorer-sample")

    def badness(part: pa.RecordBatch) -> np.ndarray:
        clean = [1 - np.array([posterior[f].get(c, 0.0) for c in part.column(f).to_pylist()]) for f in ("junk", "abuse")]
        return 1 - clean[0] * clean[1]

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            m = Measured(part.column("text"))
            bad = badness(part)[m.rows[m.distinct]]
            yield pa.record_batch([pa.array(m.hashes[m.distinct].view(np.int64)), pa.array(bad)], ["word", "bad"])

    def document_rows(listed: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                m = Measured(part.column("text"))
                order = np.argsort(m.rows[m.distinct], kind="stable")
                words, rows = m.hashes[m.distinct][order], m.rows[m.distinct][order]
                hit, at = found(words, listed) if len(listed) else (np.zeros(len(words), bool), rows)
                cut = np.searchsorted(rows[hit], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(badness(part)),
                        pa.array(dense(m).tolist(), pa.list_(pa.float64())),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(at[hit].astype(np.int32))),
                    ],
                    ["doc_id", "bad", "dense", "words"],
                )

        return run

    k = len(MEASURES) + 1
    patterns = table.groupBy("junk", "abuse").count().collect()
    total = sum(r["count"] for r in patterns)
    if not total:
        return Scorer(np.zeros(0, np.uint64), np.append(np.zeros(k - 1), -1.0))
    mean = sum(
        r["count"] * (1 - (1 - posterior["junk"].get(r["junk"], 0.0)) * (1 - posterior["abuse"].get(r["abuse"], 0.0)))
        for r in patterns
    ) / total
    # How many standard deviations a word's documents are worse or better than all.
    z = (F.col("bad") - F.col("n") * mean) / F.sqrt(F.col("n") * (mean * (1 - mean) + 1e-9))
    chosen = (
        table.mapInArrow(word_rows, "word long, bad double")
        .groupBy("word")
        .agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
        .where("n >= 5")
        .select("word", F.abs(z).alias("z"))
        .where("z > 4")
        .orderBy(F.desc("z"), "word")
        .limit(FEATURES)
        .collect()
    )
    listed = np.sort(np.array([r["word"] for r in chosen], np.int64).view(np.uint64))
    schema = "doc_id long, bad double, dense array<double>, words array<int>"
    rows = table.mapInArrow(document_rows(listed), schema).toArrow().sort_by("doc_id")
    release(table)
    lists = rows.column("words").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    x = rows.column("dense").combine_chunks().flatten().to_numpy().reshape(-1, k)
    return Scorer(listed, logistic(x, row, lists.flatten().to_numpy(), len(listed), rows.column("bad").to_numpy()))


def logistic(x: np.ndarray, row: np.ndarray, column: np.ndarray, n: int, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression with soft targets by Adam; ``row`` and ``column`` place ones."""
    k = x.shape[1]
    w, m, v = np.zeros(k + n), np.zeros(k + n), np.zeros(k + n)
    for t in range(1, rounds + 1):
        score = x @ w[:k] + np.bincount(row, w[k:][column], len(x))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        grad = np.concatenate([x.T @ error, np.bincount(column, error[row], n)]) / len(x)
        grad[: k - 1] += 1e-5 * w[: k - 1]
        grad[k:] += 1e-5 * w[k:]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w
