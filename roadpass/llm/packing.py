"""Best-fit packing of tokenised documents into sequences of a fixed length.

1. Every document becomes token ids and a closing id 0; a document longer than a sequence
   is cut into whole sequences with the shorter rest in front.
2. Lengths are counted. There are at most ``capacity`` different ones, so the counts are a
   bounded summary of all documents, whatever their number.
3. Best-fit decreasing over that summary: lengths fall, and each document goes to the open
   sequence with the least room that still holds it, which a segment tree over remaining
   capacities finds in logarithmic time. Equal sequences and equal documents are handled as
   runs, which gives the same packing as one document at a time. The plan says which
   documents of a length, by number, go to which sequences.
4. Documents are numbered within their length and look their place up in the plan.

One global packing results: nothing is packed per partition, and no text or document id
passes the driver.

Edge cases: a null or empty text is the single id 0; repeated rows are packed each; a null
``doc_id`` is packed like any other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.llm.ranks import ranked
from roadpass.llm.scratch import stored
from roadpass.llm.words import slices

CAPACITY = 2048
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\u00a1-\u024f]|<\|")

PLAN_COLUMNS = ("length", "rank_from", "first_bin", "per_bin", "offset")


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(
        texts.mapInArrow(
            _pieces(tokenizer_path, ranks_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
        ),
        "pieces",
    )
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit_decreasing(counts, capacity)
    numbered = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"])
    return numbered.mapInArrow(
        _places(plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


class CapacityTree:
    """A segment tree over remaining capacities that finds the tightest one in use."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [False] * (2 * self.size)

    def mark(self, room: int, used: bool) -> None:
        i = room + self.size
        self.used[i] = used
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest room in use that is at least ``need``."""
        i = need + self.size
        if self.used[i]:
            return need
        while i > 1:
            # The right neighbour's subtree holds the next larger rooms.
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, rank_from, first_bin, per_bin, offset), ordered by length and rank.

    Document number r of a length, counted from ``rank_from``, goes to sequence
    ``first_bin + r // per_bin`` at ``offset + (r % per_bin) * length``.
    """
    tree, rooms, plan, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            rooms.setdefault(room, []).append((first, count))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        placed, total = 0, counts[length]
        while placed < total:
            left = total - placed
            room = tree.tightest(length)
            if room is None:
                need = -(-left // (capacity // length))
                put(capacity, bins, need)
                bins += need
                continue
            first, count = rooms[room].pop()
            if not rooms[room]:
                tree.mark(room, False)
            # The tightest open sequence stays the tightest while it is filled.
            fits = room // length
            whole = min(count, left // fits)
            offset = capacity - room
            if whole:
                plan.append((length, placed, first, fits, offset))
                placed += whole * fits
                put(room - fits * length, first, whole)
            if whole < count and placed < total:
                rest = total - placed
                plan.append((length, placed, first + whole, rest, offset))
                placed = total
                put(room - rest * length, first + whole, 1)
                whole += 1
            put(room, first + whole, count - whole)
    rows = np.array(plan, np.int64).reshape(-1, len(PLAN_COLUMNS))
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _places(plan: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ranks of one length stay below this, so length and rank make one sorted key.
        span = np.int64(1) << 50
        keys = plan[:, 0] * span + plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length * span + rank, "right") - 1] if len(length) else plan[:0]
            k = rank - row[:, 1]
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                    pa.array(row[:, 2] + k // row[:, 3]),
                    pa.array(row[:, 4] + k % row[:, 3] * length),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, as the tokenizer file gives them.

    With ``ranks_path``, the same vocabulary's rank file, texts of common Latin characters
    go through the faster library; both split them alike. Other texts, and such that hold a
    special token's string, use the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and not _UNUSUAL.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _pieces(path: str, ranks_path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks_path)
        for part in slices(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = part.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                data = encoder.encode(text) + b"\0\0\0\0"
                n = len(data) // 4
                at = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run
