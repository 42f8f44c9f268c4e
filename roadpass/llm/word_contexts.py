"""Predictions of words from the two words before, over tables that grow with the corpus.

Every token is first one binary decision: is it among the words that were seen in training
after the same two words? The decision is predicted by the context's own counts and by a
gate (how often the context was seen, and with how many different words), combined in the
logistic domain with weights that the gate selects. If it is, the context's relative
frequencies say which word; if not, the word comes from the models without context. Both
ways are summed up, so the probabilities of all words after a context add up to one.

Contexts are hashed. Their counts lie in parts dealt by hash, each one task's work; the number of
parts follows the size of the corpus, so a part does not grow with it. Each block of texts
sends its different (context, word) pairs to the parts as packed numbers and gets a
prediction back for each. Weights learn online, part by part, on training occurrences with
the occurrence itself taken out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from roadpass.llm.words import mix

PART_BYTES = 6 << 20
# Bits of a context and of a word in a packed pair.
CONTEXT_BITS, WORD_BITS = 40, 16
SEEN_LEVELS, KIND_LEVELS = 12, 5
GATES = SEEN_LEVELS * KIND_LEVELS
INPUTS = 2
BATCH = 16384
RATE = 0.1
# Predictions are sent back in steps of 1 / 8 (logistic domain) and of 1 / 4096 (log10).
STRETCH, FREQUENCY = 8, 4096
NEVER = 65535

PAIRS = "block long, part int, pairs binary, counts binary"
PREDICTED = "block long, part int, gate binary, evidence binary, frequency binary, place int, value double, seen double"

_TURNS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Different sorted numbers as their gaps, byte by byte, so that the empty high bytes pack away."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = unpack(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def sequence(numbers: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts of so many words, number ``end`` after each text, and their texts."""
    rows = np.repeat(np.arange(len(sizes)), sizes + 1)
    tokens = np.full(len(rows), end, np.int64)
    inside = np.ones(len(rows), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    tokens[inside] = numbers
    return tokens, rows


def pairs_of(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A packed (context, word) and the bits that deal it to a part, for every token."""
    before = []
    for back in (1, 2):
        at = np.arange(len(tokens)) - back
        same = (at >= 0) & (rows[np.maximum(at, 0)] == rows)
        before.append(np.where(same, tokens[np.maximum(at, 0)], np.uint64(back)))
    context = mix(before[0] * _TURNS[0] + mix(before[1] + _TURNS[1]))
    del before
    word = mix(tokens ^ context) >> np.uint64(64 - WORD_BITS)
    pair = context >> np.uint64(64 - CONTEXT_BITS) << np.uint64(WORD_BITS) | word
    return pair, (context & np.uint64((1 << 24) - 1)).astype(np.int64)


def placed(tokens: np.ndarray, rows: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's different pairs, ordered by part, the parts they go to, and each token's place among them."""
    pair, deal = pairs_of(tokens, rows)
    part = (deal % parts).astype(np.int32)
    del deal
    order = np.lexsort((pair, part))
    pair, part = pair[order], part[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (part[1:] != part[:-1])
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return pair[new], part[new], place


def block_pairs(block: int, tokens: np.ndarray, rows: np.ndarray, training: np.ndarray, parts: int) -> list[tuple]:
    """Rows of a block's different pairs, one a part; ``training`` tells how often a text counts."""
    pair, part, place = placed(tokens, rows, parts)
    count = np.minimum(np.bincount(place, training[rows], len(pair)), 2**31 - 1).astype(np.int32)
    cut = np.searchsorted(part, np.arange(parts + 1)).tolist()
    return [(block, p, pack_sorted(pair[a:b]), pack(count[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]


def gates(seen: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The gate of contexts seen so often with so many different words."""
    level = np.minimum(np.log2(1 + seen), SEEN_LEVELS - 1).astype(np.int64)
    share = np.minimum((KIND_LEVELS - 1) * kinds / np.maximum(seen, 1), KIND_LEVELS - 1).astype(np.int64)
    return level * KIND_LEVELS + share


def evidence(seen: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """How often the context repeated a word rather than met a new one, in the logistic domain."""
    return np.log((seen - kinds + 0.4) / (kinds + 0.4))


def learn(weights: np.ndarray, gate: np.ndarray, x: np.ndarray, hit: np.ndarray, often: np.ndarray) -> None:
    """Online steps of the weights over decisions that occurred ``often`` times."""
    for at in range(0, len(gate), BATCH):
        g, bit, w = gate[at : at + BATCH], hit[at : at + BATCH], often[at : at + BATCH]
        inputs = np.stack([x[at : at + BATCH], np.full(len(g), 1.0)], axis=1)
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", inputs, weights[g]), -16, 16)))
        error = (bit - p) * w
        step = np.stack([np.bincount(g, error * inputs[:, i], GATES) for i in range(INPUTS)], axis=1)
        curve = np.bincount(g, w * np.maximum(p * (1 - p), 0.02) * np.einsum("ij,ij->i", inputs, inputs), GATES)
        weights += np.clip(step / (curve + 10.0)[:, None], -RATE, RATE)


def blank() -> np.ndarray:
    return np.stack([np.full(GATES, 0.5), np.full(GATES, -0.5)], axis=1)


def _part(rows: list[dict]) -> tuple[list[tuple], np.ndarray, float]:
    """Predictions for every block's pairs of one part, the learnt weights and their occurrences."""
    sent = [unpack_sorted(r["pairs"]) for r in rows]
    sizes, pair = [len(v) for v in sent], np.concatenate(sent)
    del sent
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    at = np.empty(len(order), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    del order
    total = np.bincount(at, np.concatenate([unpack(r["counts"], np.int32) for r in rows]))
    context = pair[new] >> np.uint64(WORD_BITS)
    first = np.ones(len(context), bool)
    first[1:] = context[1:] != context[:-1]
    owner = np.cumsum(first) - 1
    seen = np.bincount(owner, total)[owner]
    kinds = np.bincount(owner, total > 0)[owner]
    # Online, over training pairs in a fixed order, each without one occurrence of its own.
    weights, some = blank(), total > 0
    left, hit = seen[some] - 1, total[some] > 1
    fewer = kinds[some] - ~hit
    open_ = left > 0
    learn(weights, gates(left, fewer)[open_], evidence(left, fewer)[open_], hit[open_].astype(float), total[some][open_])
    with np.errstate(divide="ignore"):
        frequency = np.minimum(np.round(-FREQUENCY * np.log10(total / np.maximum(seen, 1))), NEVER)
    coded = (
        np.where(seen > 0, gates(seen, kinds), 255).astype(np.uint8),
        np.clip(np.round(STRETCH * evidence(seen, kinds)), -127, 127).astype(np.int8),
        frequency.astype(np.uint16),
    )
    out, start = [], 0
    for r, n in zip(rows, sizes, strict=True):
        here = at[start : start + n]
        out.append((r["block"], r["part"], *(pack(c[here]) for c in coded)))
        start += n
    return out, weights, float(total[some][open_].sum())


def predictions(pairs: DataFrame) -> DataFrame:
    """For every row of a block and a part its pairs' predictions; and, as rows without block,
    each part's weights times the occurrences they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches):
            out, weights, seen = _part(part)
            kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
            n, w = len(out), weights.size if seen else 0
            columns = [pa.concat_arrays([pa.array(c, k), pa.nulls(w, k)]) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            learnt = [np.arange(w, dtype=np.int32), weights.ravel()[:w] * seen, np.full(w, seen)]
            columns += [pa.concat_arrays([pa.nulls(n, a.type), a]) for a in map(pa.array, learnt)]
            yield pa.record_batch(columns, [f.split()[0] for f in PREDICTED.split(", ")])

    dealt = pairs.repartition("part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(run, PREDICTED)


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of a partition sorted by part, part by part."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["part"] != row["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shares(rows: list[dict], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a block's pairs, in the order of its parts: the probability that a word seen after
    the context follows, and the pair's frequency among those."""
    rows = sorted(rows, key=lambda r: r["part"])
    gate = np.concatenate([unpack(r["gate"], np.uint8) for r in rows])
    x = np.concatenate([unpack(r["evidence"], np.int8) for r in rows]) / STRETCH
    raw = np.concatenate([unpack(r["frequency"], np.uint16) for r in rows]).astype(float)
    known = gate < 255
    w = weights[np.where(known, gate, 0)]
    p = np.where(known, 1 / (1 + np.exp(-np.clip(w[:, 0] * x + w[:, 1], -16, 16))), 0.0)
    return p, np.where(raw < NEVER, 10.0 ** (-raw / FREQUENCY), 0.0)
