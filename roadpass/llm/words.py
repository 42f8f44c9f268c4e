"""Words and word hashes of Arrow text columns, as numpy arrays.

A word is a maximal run of characters other than space and U+0009 to U+000D. The text
stays in its UTF-8 buffer; nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# Text bytes handled at once; a single longer text is one slice.
SLICE_BYTES = 4 << 20
_HASH_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240101))
_BYTE_CODE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, _HASH_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _HASH_BYTES, "right")))
        at, to = starts[i], ends[j - 1]
        up, down = _power(int(to - at) + 1)
        total = np.zeros(int(to - at) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[at:to]] * up[: to - at], out=total[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


class Words:
    """The words of a slice of texts.

    ``starts`` and ``ends`` are byte places in ``data``; the words of text ``r`` are
    ``bounds[r]:bounds[r + 1]``. ``outside`` tells bytes that no word holds, after lowering.
    """

    def __init__(self, column: pa.Array, lower: bool = False, outside: np.ndarray = _SPACE):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        inside = ~outside[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:] | first[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the row offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that a slice holds few text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64))
        i = 0
        while i < batch.num_rows:
            before = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def window_sums(values: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of every run of ``width`` values, by its first place."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += values[j : j + n] * factors[j]
    return mix(out)


def places(bounds: np.ndarray, width: int) -> np.ndarray:
    """Places where ``width`` consecutive words of one text start."""
    counts = np.diff(bounds)
    total = int(bounds[-1])
    ok = np.ones(total, bool)
    # The last width - 1 words of each text start no full window.
    last = np.repeat(bounds[1:], counts) - np.arange(total)
    ok &= last >= width
    return np.flatnonzero(ok)


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    chosen = np.flatnonzero(keep)
    row = words.rows[chosen]
    last = np.ones(len(chosen), bool)
    last[:-1] = row[1:] != row[:-1]
    data = words.data.copy()
    data[words.ends[chosen[~last]]] = 0x20
    change = np.zeros(len(data) + 1, np.int8)
    change[words.starts[chosen]] += 1
    change[words.ends[chosen] + ~last] -= 1
    shown = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    length = np.concatenate([[0], np.cumsum(shown)])
    out = data[shown]
    offsets = length[words.offsets].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())
