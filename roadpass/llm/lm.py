"""Language-model scores of texts by online logistic context mixing.

Texts are lower-cased (A to Z) and read as words and one end each. Three models meet in every
token: the two words before (``word_contexts``), whose tables grow with the corpus; the
word's frequency; and its spelling, bit by bit (``context_mixing``), computed once per
different word, since its contexts lie in the word.

1. Texts are cut into blocks. A block stores its texts as numbers of its own words, and its
   words with their training counts, packed and dealt to parts by hash. Parts sum up the
   counts of all blocks: this vocabulary grows with the corpus, and so do the parts.
2. Pairs meet in parts by their context; parts learn gated weights online and send each
   block its predictions.
3. Different words, sorted and dealt by range, give the counts of every spelling context's
   next bytes; the counts of all decisions are summed into hashed tables.
4. Every range of words trains mixing weights online, weighted by training counts; the
   ranges' weights are averaged by the occurrences they saw.
5. Every different word is scored; parts send each block its words' counts and spellings,
   and blocks mix these with the predictions token by token and add them up per text.

``score`` uses the alphabet of ``base_score``: training words, the end, and one symbol for
all other words. The share of other words is what the training words that occur once show
(removing one such occurrence makes it an unknown word); the spelled probabilities of
training words are divided by their sum and averaged with the words' frequencies
(``PLAIN`` is the latter's share). ``bits_per_byte`` spells unknown words instead.

Edge cases: a null text is empty and scores its end; a null ``doc_id`` is not held out;
repeated rows count each; without training texts every token is unknown; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass.llm import context_mixing as M
from roadpass.llm import word_contexts as C
from roadpass.llm.scratch import release, stored
from roadpass.llm.words import Words, slices

FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 5 << 20
# Words are found in pieces of a block, and few rows are sent to Python at once: both
# take many times their bytes.
PIECE_BYTES = 1 << 20
TEXT_ROWS, PACKED_ROWS = 64, 4
PLAIN = 0.7
END_HASH = np.uint64(0x2545F4914F6CDD1D)

_BLOCK = (
    "block long, part int, hashes binary, words binary, counts binary,"
    " doc_id array<long>, held_out array<boolean>, sizes array<int>, bytes array<long>, tokens binary"
)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-size // C.PART_BYTES))
    # A block's words have parts from 0; the row of its texts has part -1.
    spark = docs.sparkSession
    with _arrow_rows(spark, TEXT_ROWS):
        blocks = stored(texts.mapInArrow(_blocks(parts), _BLOCK), "text-blocks")
    held = blocks.where("part = -1").select("block", "held_out", "sizes", "tokens", "hashes")
    with _arrow_rows(spark, PACKED_ROWS):
        predicted = stored(C.predictions(held.mapInArrow(_pairs(parts), C.PAIRS)), "word-predictions")
    words = blocks.where("part >= 0")
    dealt = words.select("block", "part", "hashes", "words", "counts").repartition("part").sortWithinPartitions("part", "block")
    with _arrow_rows(spark, PACKED_ROWS):
        vocabulary = stored(dealt.mapInArrow(_vocabulary, "hash long, word binary, count long"), "vocabulary")
    facts = vocabulary.where("count > 0").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"),
        F.count("*").alias("words"),
        F.count(F.when(F.col("count") == 1, 1)).alias("once"),
    ).first()
    ordered = stored(
        vocabulary.repartitionByRange("word").sortWithinPartitions("word"), "ordered-vocabulary"
    )
    release(vocabulary)
    table = spark_broadcast(ordered, _tables(ordered))
    weights, refine = _trained(ordered, table)
    scored = stored(
        ordered.mapInArrow(_score_words(table, weights, refine), "hash long, count long, spelled double"), "word-scores"
    )
    release(ordered)
    total = scored.where("count > 0").agg(F.sum(F.pow(F.lit(10.0), "spelled"))).first()[0] or 1.0
    unknown = min(0.5, max(facts["once"], 1) / max(facts["tokens"], 1)) if facts["words"] else 1.0
    by_part = scored.withColumn("part", F.pmod("hash", F.lit(parts)).cast("int")).groupBy("part")
    lookup = stored(
        words.select("block", "part", "hashes").groupBy("part").cogroup(by_part).applyInArrow(
            _look_up, "block long, part int, counts binary, spelled binary"
        ),
        "block-scores",
    )
    release(scored)
    # The blocks' words are spent; without them there is room for the last shuffle.
    texts_of = ("block", "doc_id", "held_out", "sizes", "bytes", "tokens", "hashes")
    whole = stored(blocks.where("part = -1").select(*texts_of), "block-texts")
    release(blocks)
    learnt = predicted.where("block is null").groupBy("place").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # As many rows as the gates have weights.
    gated = C.blank().ravel()
    for r in learnt.collect():
        gated[r["place"]] = r["value"] / r["seen"]
    finish = _finish(
        parts, facts["tokens"], facts["words"], unknown, math.log10(max(1e-300, 1 - unknown)) - math.log10(total), gated.reshape(C.GATES, C.INPUTS)
    )
    fetched = lookup.unionByName(
        predicted.where("block is not null").select("block", "part", "gate", "evidence", "frequency"), allowMissingColumns=True
    )
    return whole.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(
        finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double, bits_per_byte double",
    )


@contextmanager
def _arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables stored inside the block send at most so many rows to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def _block_rows():
    names = [f.split()[0] for f in _BLOCK.split(", ")]
    kinds = dict(
        zip(
            names,
            [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()),
             pa.list_(pa.int64()), pa.binary()],
            strict=True,
        )
    )

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.record_batch([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names], names)

    return rows


def _blocks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for pieces in _gathered(batches):
            yield from _block(pieces, number, parts)
            number += 1

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The pieces of one block after the other."""
    held, size = [], 0
    for piece in slices(batches, limit=PIECE_BYTES):
        n = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
        if held and size + n > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield held


def _words_of(pieces: list[pa.RecordBatch]) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a block's words, its bytes and the words' places in them, the words of each
    text and the texts' lengths."""
    columns, base = [], 0
    for piece in pieces:
        texts = Words(piece.column("text"), lower=True)
        columns.append((texts.hashes(), texts.data, texts.starts + base, texts.ends + base, texts.counts, np.diff(texts.offsets)))
        base += len(texts.data)
    hashes, data, *rest = (np.concatenate(c) for c in zip(*columns, strict=True))
    return hashes, data.tobytes(), *rest


def _block(pieces: list[pa.RecordBatch], number: int, parts: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The rows of a block's words and of its texts; what they are made of is freed on return."""
    rows = _block_rows()
    hashes, view, starts, ends, sizes, lengths = _words_of(pieces)
    unique, first, tokens, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    del hashes
    # Frequent words get small numbers, which pack well.
    order = np.argsort(-often, kind="stable")
    unique, first = unique[order], first[order]
    number_of = np.empty(len(order), np.int32)
    number_of[order] = np.arange(len(order))
    tokens = number_of[tokens]
    held = np.concatenate([p.column("held_out").to_numpy(zero_copy_only=False) for p in pieces])
    training = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(unique))
    words = [view[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    del view, starts, ends
    # The end of a text is a word without bytes.
    words.append(b"")
    unique, training = np.append(unique, END_HASH), np.append(training, np.count_nonzero(~held))
    order, cut = _dealt(unique, parts)
    packed = [
        (p, C.pack_sorted(unique[at]), zstandard.compress(b"\n".join([words[i] for i in at.tolist()]), 1), C.pack(training[at]))
        for p, at in ((p, order[a:b]) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b)
    ]
    places, *columns = zip(*packed, strict=True)
    n = len(places)
    return (
        rows(n, block=[number] * n, part=places, hashes=columns[0], words=columns[1], counts=columns[2]),
        rows(
            1,
            block=[number],
            part=[-1],
            hashes=[unique.tobytes()],
            doc_id=[[i for p in pieces for i in p.column("doc_id").to_pylist()]],
            held_out=[held.tolist()],
            sizes=[sizes.tolist()],
            bytes=[lengths.tolist()],
            tokens=[C.pack(tokens)],
        ),
    )


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, list[int]]:
    """The order of a block's words by part and hash, and where each part begins in it."""
    part = hashes.view(np.int64) % parts
    order = np.lexsort((hashes, part))
    return order, np.searchsorted(part[order], np.arange(parts + 1)).tolist()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every part's different words and their training counts over all blocks."""
    for rows in C.parts_of(batches):
        hashes = np.concatenate([C.unpack_sorted(r["hashes"]) for r in rows])
        counts = np.concatenate([C.unpack(r["counts"], np.int64) for r in rows])
        words = [w for r in rows for w in zstandard.decompress(r["words"]).split(b"\n")]
        unique, first, same = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(same, counts, len(unique)).astype(np.int64)
        yield pa.record_batch(
            [pa.array(unique.view(np.int64)), pa.array([words[i] for i in first.tolist()], pa.binary()), pa.array(total)],
            ["hash", "word", "count"],
        )


def _look_up(words: pa.Table, scored: pa.Table) -> pa.Table:
    """Counts and spellings of every block's words of one part, in the order of their hashes."""
    hashes = scored.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    count, spelled = scored.column("count").to_numpy()[order], scored.column("spelled").to_numpy()[order].astype(np.float32)
    out = []
    for row in words.to_pylist():
        at = np.searchsorted(hashes, C.unpack_sorted(row["hashes"]))
        out.append((row["block"], row["part"], C.pack(count[at]), C.pack(spelled[at])))
    kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary()
    columns = zip(*out, strict=True) if out else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "part", "counts", "spelled"])


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of a block's tokens, the texts they stand in, and the tokens' hashes."""
    hashes = np.frombuffer(row["hashes"], np.uint64)
    number, owner = C.sequence(C.unpack(row["tokens"], np.int32), np.array(row["sizes"], np.int64), len(hashes) - 1)
    return number, owner, hashes[number]


def _pairs(parts: int):
    kinds = pa.int64(), pa.int32(), pa.binary(), pa.binary()

    def pairs(row: dict) -> pa.RecordBatch:
        _, owner, tokens = _tokens(row)
        out = C.block_pairs(row["block"], tokens, owner, (~np.array(row["held_out"], bool)).astype(float), parts)
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.record_batch(columns, [f.split()[0] for f in C.PAIRS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pairs(batch.slice(i, 1).to_pylist()[0])

    return run


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, pa.RecordBatch]]:
    for batch in batches:
        for at in range(0, batch.num_rows, M.BATCH):
            part = batch.slice(at, M.BATCH)
            yield part.column("word").to_pylist(), part.column("count").to_numpy(), part


def _tables(ordered: DataFrame) -> np.ndarray:
    """Counts of all decisions; ``M.CHUNKS`` chunks of a fixed size, summed up on the executors."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts, _ in _word_batches(batches):
            known = np.flatnonzero(counts > 0)
            s = M.Spellings([words[i] for i in known.tolist()])
            if not len(s.byte):
                continue
            weight = np.bincount(s.edge, counts[known].astype(np.float64)[s.word], len(s.byte))
            for i in range(M.ORDERS + 1):
                # The same context and byte may follow several beginnings.
                key = M.mix(s.contexts[i] + s.byte.astype(np.uint64))
                _, at, same = np.unique(key, return_index=True, return_inverse=True)
                total = np.bincount(same, weight, len(at))
                context, byte, chunk = s.contexts[i][at], s.byte[at], s.chunks(i)[at]
                order = np.argsort(chunk, kind="stable")
                chunks, start = np.unique(chunk[order], return_index=True)
                cut = np.append(start, len(order))
                yield pa.record_batch(
                    [
                        pa.array(chunks.astype(np.int32)),
                        *(
                            pa.array([v[order[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                            for v in (context, byte, total)
                        ),
                    ],
                    ["chunk", "context", "byte", "total"],
                )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << M.SLOT_BITS
        for group in runs_of_chunks(batches):
            chunk, rows = group
            table = np.zeros((size, 2))
            for context, byte, total in rows:
                for node, bit in M.nodes(byte):
                    at = M.slots(context, node)
                    table[:, 0] += np.bincount(at, total * (1 - bit), size)
                    table[:, 1] += np.bincount(at, total * bit, size)
            yield pa.record_batch([pa.array([chunk], pa.int32()), pa.array([table.astype(np.float32).tobytes()], pa.binary())], ["chunk", "table"])

    packed = ordered.mapInArrow(edges, "chunk int, context binary, byte binary, total binary")
    filled = stored(
        packed.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(fill, "chunk int, table binary"), "context-tables"
    )
    out = np.zeros((M.CHUNKS << M.SLOT_BITS, 2), np.float32)
    for row in filled.toLocalIterator():
        at = row["chunk"] << M.SLOT_BITS
        out[at : at + (1 << M.SLOT_BITS)] = np.frombuffer(row["table"], np.float32).reshape(-1, 2)
    return out


def runs_of_chunks(batches: Iterator[pa.RecordBatch]):
    """(chunk, rows) of a partition sorted by chunk; rows are read as they come."""


    def rows():
        for batch in batches:
            for chunk, *values in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                yield chunk, [np.frombuffer(v, t) for v, t in zip(values, (np.uint64, np.uint8, np.float64), strict=True)]

    for chunk, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield chunk, (values for _, values in group)


def _trained(ordered: DataFrame, table) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights, averaged over the word ranges, and the summed refinement map."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = M.Model(table.value), 0
        for words, counts, _ in _word_batches(batches):
            known = np.flatnonzero(counts > 0)
            if len(known):
                model.learn([words[i] for i in known.tolist()], counts[known])
                seen += int(counts[known].sum())
        if seen:
            values = np.concatenate([model.weights.ravel() * seen, model.refine.ravel()])
            yield pa.record_batch(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values), pa.array(np.full(len(values), float(seen)))],
                ["place", "value", "seen"],
            )

    sums = ordered.mapInArrow(train, "place int, value double, seen double").groupBy("place").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen")
    )
    # As many rows as the model has weights.
    rows = {r["place"]: r for r in sums.collect()}
    blank = M.Model(table.value)
    if not rows:
        return blank.weights, blank.refine
    values = np.array([rows[i]["value"] for i in range(len(rows))])
    n = blank.weights.size
    return (values[:n] / rows[0]["seen"]).reshape(blank.weights.shape), values[n:].reshape(blank.refine.shape)


def _score_words(table, weights: np.ndarray, refine: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = M.Model(table.value, weights, refine)
        for words, _, part in _word_batches(batches):
            yield pa.record_batch([part.column("hash"), part.column("count"), pa.array(model.log10(words))], ["hash", "count", "spelled"])

    return run


def _finish(parts: int, tokens: int, distinct: int, unknown: float, scale: float, gated: np.ndarray):
    def run(texts, fetched):
        words = pc.is_valid(fetched.column("counts"))
        lookup = sorted(fetched.filter(words).select(["part", "counts", "spelled"]).to_pylist(), key=lambda r: r["part"])
        (row,) = texts.to_pylist()
        order, _ = _dealt(np.frombuffer(row["hashes"], np.uint64), parts)
        count, spelled = np.zeros(len(order), np.int64), np.zeros(len(order))
        count[order] = np.concatenate([C.unpack(r["counts"], np.int64) for r in lookup])
        spelled[order] = np.concatenate([C.unpack(r["spelled"], np.float32) for r in lookup])
        known = count > 0
        base = np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1)))
        mixed = PLAIN * (1 - unknown) * count / max(tokens, 1) + (1 - PLAIN) * 10.0 ** np.where(known, spelled + scale, -np.inf)
        closed, letters = np.where(known, mixed, unknown), 10.0**spelled
        del lookup, order, mixed, spelled
        sizes = np.array(row["sizes"], np.int64)
        n = len(sizes)
        number, owner, hashes = _tokens(row)
        at = C.placed(hashes, owner, parts)[2]
        del hashes
        follows, frequency = C.shares(fetched.filter(pc.invert(words)).to_pylist(), gated)
        p, seen = follows[at], follows[at] * frequency[at]
        del at, follows, frequency
        # A space or the end follows each word in the spelling.
        length = np.array(row["bytes"], np.int64) + 1
        bits = np.bincount(owner, np.log10(seen + (1 - p) * letters[number]), n)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_id"], pa.int64()),
                "held_out": pa.array(row["held_out"], pa.bool_()),
                "n_tokens": sizes + 1,
                "n_known": np.bincount(owner, known[number], n).astype(np.int64),
                "train_tokens": np.full(n, tokens),
                "base_score": np.bincount(owner, base[number], n),
                "score": np.bincount(owner, np.log10(seen + (1 - p) * closed[number]), n),
                "bits_per_byte": -bits * np.log2(10) / length,
            }
        )

    return run
