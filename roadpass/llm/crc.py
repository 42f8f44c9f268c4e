"""CRC-32 of many byte spans at once, by a table of positions.

A CRC is linear but for a constant that depends on the length: it is the exclusive or of
what every byte adds given how many bytes follow it, and of the CRC of as many zero bytes.
The table holds what each byte adds for distances below ``DEPTH``; a longer span is cut into
blocks from its end and the blocks are folded in pairs, each pair moving the left block
past the right one.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64
# Bytes gathered at once; a single longer span is cut into blocks anyway.
GATHER = 1 << 20

# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ np.uint32(POLYNOMIAL), value >> 1)
    return value


_BYTE = _byte_table()


def _past_zero(state: np.ndarray) -> np.ndarray:
    """The state after one more zero byte."""
    return _BYTE[state & 0xFF] ^ state >> np.uint32(8)


def _position_table() -> np.ndarray:
    rows = [_BYTE]
    for _ in range(DEPTH - 1):
        rows.append(_past_zero(rows[-1]))
    return np.concatenate(rows)


_POSITION = _position_table()


def _moves() -> list[np.ndarray]:
    """For each power of two, what each of a state's four bytes becomes past so many zero bytes."""
    one = np.concatenate([_past_zero(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
    out = [one]
    for _ in range(40):
        out.append(_moved(out[-1], out[-1]))
    return out


def _moved(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    return (
        table[state & 0xFF]
        ^ table[256 + (state >> np.uint32(8) & 0xFF)]
        ^ table[512 + (state >> np.uint32(16) & 0xFF)]
        ^ table[768 + (state >> np.uint32(24))]
    )


_MOVES = _moves()


def _constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC of as many zero bytes as each length says."""
    longest = int(lengths.max(initial=0))
    state = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for k in range(longest.bit_length()):
        on = lengths >> k & 1 == 1
        state[on] = _moved(state[on], _MOVES[k])
    return state ^ np.uint32(0xFFFFFFFF)


_SHORT = _constants(np.arange(DEPTH + 1))


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The exclusive or of what the bytes add, for spans of 1 to ``DEPTH`` bytes."""
    lengths = ends - starts
    out = np.empty(len(starts), np.uint32)
    total = np.cumsum(lengths)
    i = 0
    while i < len(starts):
        before = int(total[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + GATHER, "right")))
        size = lengths[i:j]
        first = total[i:j] - size - before
        place = np.arange(int(total[j - 1]) - before)
        at = place + np.repeat(starts[i:j] - first, size)
        left = np.repeat(first + size - 1, size) - place
        out[i:j] = np.bitwise_xor.reduceat(_POSITION[left << 8 | data[at]], first)
        i = j
    return out


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same for longer spans, block by block."""
    blocks = -((starts - ends) // DEPTH)
    span = np.repeat(np.arange(len(starts)), blocks)
    # Blocks count from the end of their span; the first one of a span may be shorter.
    back = np.repeat(np.cumsum(blocks) - 1, blocks) - np.arange(len(span))
    block_end = ends[span] - back * DEPTH
    value = _linear(data, np.maximum(starts[span], block_end - DEPTH), block_end)
    power = DEPTH.bit_length() - 1
    while back.any():
        odd = back & 1 == 1
        value[odd] = _moved(value[odd], _MOVES[power])
        back = back >> 1
        new = np.ones(len(span), bool)
        new[1:] = (span[1:] != span[:-1]) | (back[1:] != back[:-1])
        first = np.flatnonzero(new)
        value, span, back = np.bitwise_xor.reduceat(value, first), span[first], back[first]
        power += 1
    return value


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span ``data[start:end]``; spans may overlap and may be empty."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)
    short = (lengths > 0) & (lengths <= DEPTH)
    out[short] = _linear(data, starts[short], ends[short]) ^ _SHORT[lengths[short]]
    long = lengths > DEPTH
    if long.any():
        out[long] = _folded(data, starts[long], ends[long]) ^ _constants(lengths[long])
    return out
