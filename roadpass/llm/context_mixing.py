"""A bit-wise context-mixing model of spelled words, in numpy.

A word is spelled byte by byte and ends with a space; the end of a text is one newline byte.
No word holds either byte, so spellings are prefix-free and the probabilities of all words
and the end add up to at most one. Every byte is eight binary decisions from the highest
bit down. Each decision is predicted by several contexts, whose counts live in hashed
tables: the last one, two and three bytes and the word's beginning. The predictions are
combined in the logistic domain by weights that a gate selects (place in the word and
experience of the longest context). The weights learn online, and an adaptive map refines
the result. While learning, a word's own occurrence is taken out of the counts, so the model
learns how far to trust counts for text it has not seen.
"""

from __future__ import annotations

import numpy as np

from roadpass.llm.words import mix

ORDERS = 3
INPUTS = ORDERS + 2  # low orders, word beginning, constant
SLOT_BITS = 15
LOW_CHUNKS, PREFIX_CHUNKS = 32, 128  # chunks of 2 ** SLOT_BITS decisions each
CHUNKS = LOW_CHUNKS + PREFIX_CHUNKS
DEPTHS, LEVELS = 8, 10
GATES = DEPTHS * LEVELS
STEPS = 24
PRIOR = 0.4
BATCH = 16000
RATE = 0.04
_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Spellings:
    """The different bytes to predict in a list of words, with their contexts.

    All contexts lie in the word's beginning, so words that share a beginning share its
    bytes: ``edge`` gives for every byte of every word its place among the different ones.
    Sorted words share most.
    """

    def __init__(self, words: list[bytes]):
        texts = [w + b" " if w else b"\n" for w in words]
        self.length = np.array([len(t) for t in texts], np.int64)
        byte = np.frombuffer(b"".join(texts), np.uint8)
        n = len(byte)
        self.word = np.repeat(np.arange(len(words)), self.length)
        first = np.cumsum(self.length) - self.length
        depth = np.arange(n) - first[self.word]
        code = mix(byte.astype(np.uint64) + np.uint64(1))
        # A hash of the word's beginning before each place, from prefix sums.
        power = np.cumprod(np.full(int(self.length.max(initial=1)), _TURN[0]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(code * power[depth])])
        begin = total[:-1] - total[first][self.word]
        begin = mix(begin + depth.astype(np.uint64) * _TURN[2])
        _, at, self.edge = np.unique(begin * _TURN[1] + code, return_index=True, return_inverse=True)
        self.byte, self.depth = byte[at], depth[at]
        contexts = []
        for order in range(1, ORDERS + 1):
            h = np.full(len(at), np.uint64(order))
            for back in range(1, order + 1):
                seen = np.where(self.depth >= back, code[at - np.minimum(self.depth, back)], np.uint64(0))
                h = mix(h * _TURN[1] + seen)
            contexts.append(h)
        self.contexts = [*contexts, begin[at]]

    def chunks(self, i: int) -> np.ndarray:
        """The table chunk of each place's i-th context."""
        return chunk_of(self.contexts[i], i)


def chunk_of(context: np.ndarray, i: int) -> np.ndarray:
    if i < ORDERS:
        return (context % np.uint64(LOW_CHUNKS)).astype(np.int64)
    return (context % np.uint64(PREFIX_CHUNKS)).astype(np.int64) + LOW_CHUNKS


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The place of a decision in its context's chunk."""
    return (mix(context + node.astype(np.uint64) * _TURN[1]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def nodes(byte: np.ndarray):
    """For each of the eight decisions: the bits before it with a leading 1, and its bit."""
    byte = byte.astype(np.int64)
    for k in range(7, -1, -1):
        yield (byte | 256) >> (k + 1), (byte >> k) & 1


class Model:
    """Tables of decision counts, mixing weights and the refinement map."""

    def __init__(self, table: np.ndarray, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.table = table  # (CHUNKS << SLOT_BITS, 2): how often 0 and 1 were seen
        self.weights = np.full((GATES, INPUTS), 0.3) if weights is None else weights
        self.refine = np.zeros((DEPTHS, STEPS, 2)) if refine is None else refine

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability, its end included."""
        out = np.zeros(len(words))
        for at in range(0, len(words), BATCH):
            s = Spellings(words[at : at + BATCH])
            bits = np.zeros(len(s.byte))
            for x, gate, bit in self._inputs(s, 0):
                p = self._refined(np.einsum("ij,ij->i", x, self.weights[gate]), gate)
                bits += np.log10(np.where(bit == 1, p, 1 - p))
            out[at : at + BATCH] = np.bincount(s.word, bits[s.edge], len(s.length))
        return out

    def learn(self, words: list[bytes], counts: np.ndarray) -> None:
        """One online pass over words that occur ``counts`` times each."""
        for at in range(0, len(words), BATCH):
            s = Spellings(words[at : at + BATCH])
            weight = np.bincount(s.edge, counts[at : at + BATCH].astype(np.float64)[s.word], len(s.byte))
            for x, gate, bit in self._inputs(s, 1):
                mixed = np.einsum("ij,ij->i", x, self.weights[gate])
                p = squash(mixed)
                error = (bit - p) * weight
                step = np.stack([np.bincount(gate, error * x[:, i], GATES) for i in range(INPUTS)], axis=1)
                # A step is measured by the loss's curvature, so it neither creeps nor overshoots.
                curve = np.bincount(gate, weight * np.maximum(p * (1 - p), 0.02) * np.einsum("ij,ij->i", x, x), GATES)
                self.weights += np.clip(step / (curve + 1e-3 * weight.sum())[:, None], -RATE, RATE)
                cell = gate // LEVELS * STEPS + steps(mixed)[0]
                for b in (0, 1):
                    self.refine[:, :, b] += np.bincount(cell, weight * (bit == b), DEPTHS * STEPS).reshape(DEPTHS, STEPS)

    def _inputs(self, s: Spellings, own: int):
        base = [s.chunks(i) << SLOT_BITS for i in range(ORDERS + 1)]
        place = np.minimum(s.depth, DEPTHS - 1)
        x = np.empty((len(s.byte), INPUTS))
        x[:, -1] = 0.3
        for node, bit in nodes(s.byte):
            for i in range(ORDERS + 1):
                at = base[i] + slots(s.contexts[i], node)
                zero, one = self.table[at, 0] + np.float32(PRIOR), self.table[at, 1] + np.float32(PRIOR)
                if own:
                    zero = np.maximum(zero - (1 - bit).astype(np.float32), np.float32(PRIOR))
                    one = np.maximum(one - bit.astype(np.float32), np.float32(PRIOR))
                x[:, i] = np.log(one / zero)
            level = np.minimum(np.log2(1 + zero + one) * 0.7, LEVELS - 1).astype(np.int64)
            yield x, place * LEVELS + level, bit

    def _refined(self, mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
        centre = squash(np.arange(STEPS) - STEPS / 2 + 0.5)
        table = ((self.refine[:, :, 1] + 20 * centre) / (self.refine.sum(axis=2) + 20)).ravel()
        low, share = steps(mixed)
        at = gate // LEVELS * STEPS + low
        mapped = table[at] * (1 - share) + table[at + 1] * share
        return np.clip(0.5 * squash(mixed) + 0.5 * mapped, 1e-7, 1 - 1e-7)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -16, 16)))


def steps(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The refinement step below a mixed value, and the share of the way to the next."""
    at = np.clip(mixed + STEPS / 2 - 0.5, 0, STEPS - 1.001)
    low = at.astype(np.int64)
    return low, at - low
