"""Near-duplicate documents by sketches of their word shingles.

Method: fast similarity sketching. Every shingle of a document is thrown into the sketch's
bins by one hash per round; a bin keeps the smallest value of the earliest round that
reached it. After ``bins`` rounds of random bins, round ``bins + j`` sends every shingle to
bin j, so every coordinate fills, and most documents are done after the first rounds. Two
documents agree in a coordinate with a probability equal to their similarity.

1. Documents with equal shingle sets (128-bit fingerprint and size) form one class with a
   number of its own; one of its documents goes on, so copies cost nothing further.
2. Bands of four coordinates are hashed; classes that agree in a band are candidates.
   The number of bands follows from the threshold, so that a pair at the threshold is
   missed with a probability below ``MISS``.
3. In each band bucket every member is checked against the bucket's smallest member, on
   the full shingle sets, and the links' components are formed. That settles a large
   group of near copies with one row per member and band.
4. In buckets that still hold several components, the members outside the largest one are
   compared with all members, block by block: members are dealt to blocks of about
   ``BLOCK``, and each pair of blocks is one cell, first by sketches, then the plausible
   members on their full sets. No bucket is cut.
5. Components of all links give the result.

Rows meet their class by fingerprint and a salt of the row; a class comes once for each salt
that its rows have, so a group of copies of any size is spread.

Edge cases: a null or wordless text has no shingles and is linked with nothing; a text with
fewer words than a shingle is one shingle; a null ``doc_id`` gives a null component and is
kept; rows that share a ``doc_id`` share its component, through all of its texts; equal
similarity to the threshold links; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpass.llm.components import components
from roadpass.llm.groups import runs
from roadpass.llm.scratch import release, stored, without
from roadpass.llm.words import Words, mix, places, slices, window_sums

ROWS = 4  # coordinates in a band
SALTS = 32  # parts that the rows of one class are spread over
PRINT = ["f1", "f2", "n"]
MISS = 1e-5
# Members and shingles of a block, about; a cell holds two blocks.
BLOCK = 512
BLOCK_SHINGLES = 400_000


def near_duplicates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Texts are compared without regard to the case of A to Z. Documents are linked when
    100 * intersection >= percent * union of their sets of ``shingle`` consecutive words.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("key"))
    rows, classes, links = _linked_classes(texts, shingle, percent)
    # A doc_id repeated with different texts joins their classes.
    many = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(
        *(f(c).alias(f"{f.__name__}_{c}") for c in ("f1", "f2", "n") for f in (F.min, F.max))
    )
    many = many.where("min_f1 <> max_f1 or min_f2 <> max_f2 or min_n <> max_n").select("doc_id")
    held = rows.where("n > 0").join(many, "doc_id").select("doc_id", *PRINT).distinct().join(classes.select(*PRINT, "cls"), PRINT)
    held = stored(held.select("doc_id", "cls"), "repeated-ids")
    least = held.groupBy("doc_id").agg(F.min("cls").alias("a"))
    same = held.join(least, "doc_id").select("a", F.col("cls").alias("b")).where("a <> b").distinct()
    final = components(links.unionByName(same))
    named = classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    label = named.groupBy("component").agg(F.min("first.doc_id").alias("component_id"))
    labelled = stored(named.join(label, "component").select(*PRINT, "component_id", _salts_of()), "class-components")
    release(held, classes, links, final)
    return (
        rows.join(labelled.hint("merge"), [*PRINT, "salt"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


def first_of_groups(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``key`` of the rows that stay when each group of near-duplicates keeps its smallest
    (doc_id, key), and of all rows without shingles.

    ``docs`` has doc_id, text and key, a binary name of the row; rows that share a ``doc_id``
    with unlike texts are told apart by it. Rows without doc_id are left out.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "key")
    rows, classes, links = _linked_classes(texts, shingle, percent)
    final = components(links)
    named = classes.join(final.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = named.groupBy("component").agg(F.min("first").alias("first")).select("first.key")
    kept = stored(first.unionByName(rows.where("n = 0").select("key").distinct()), "kept-keys")
    release(rows, classes, links, final)
    return kept


def _linked_classes(texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their fingerprint; classes with their number, first row and salts; links of classes."""
    bands = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))
    sketched = stored(
        texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int"))
        .mapInArrow(_sketch(shingle, bands), "doc_id long, key binary, salt int, n long, f1 long, f2 long, bands array<long>, sketch binary"),
        "sketches",
    )
    live = sketched.where("n > 0 and doc_id is not null")
    classes = stored(
        live.groupBy(*PRINT)
        .agg(F.min(F.struct("doc_id", "key")).alias("first"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
        .withColumn("cls", F.monotonically_increasing_id()),
        "set-classes",
    )
    # The sketch of one row of each class.
    chosen = stored(
        live.join(classes.select(*PRINT, "cls", F.col("first.doc_id").alias("doc_id")), [*PRINT, "doc_id"])
        .dropDuplicates(["cls"])
        .select("cls", "n", "doc_id", "bands", "sketch"),
        "class-sketches",
    )
    banded = stored(
        chosen.select("cls", "n", "doc_id", F.posexplode("bands").alias("band", "code")).select(
            "cls", "n", "doc_id", F.xxhash64("band", "code").alias("bucket")
        ),
        "bands",
    )
    # The hub is the member whose document has the smallest id, often what the others were copied from.
    member = F.struct("doc_id", "cls", "n")
    shared = stored(
        banded.groupBy("bucket").agg(F.min(member).alias("hub"), F.max(member).alias("top")).where("hub <> top").select("bucket", "hub"), "hubs"
    )
    busy = stored(banded.join(shared, "bucket").select("bucket", "cls", "n", "hub"), "shared-buckets")
    wanted = busy.select("cls").distinct().join(classes, "cls")
    sets = stored(
        texts.select("doc_id", "text")
        .join(wanted.select("cls", *PRINT, F.col("first.doc_id").alias("doc_id")), "doc_id")
        .mapInArrow(_sets(shingle), "cls long, n long, shingles binary")
        .dropDuplicates(["cls"]),
        "shingle-sets",
    )
    # Sizes must allow the threshold at all.
    fits = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    near = busy.where(fits & (F.col("cls") != F.col("hub.cls"))).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct()
    links = stored(_verified(near, sets, percent), "hub-links")
    comps = components(links)
    named = busy.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select(
        "bucket", "cls", "n", F.coalesce("component", "cls").alias("comp")
    )
    rest = _cross_links(named, sets, chosen, bands * ROWS, percent)
    out = stored(links.unionByName(rest), "class-links")
    release(banded, shared, busy, sets, links, comps, rest, chosen)
    return without(sketched, "bands", "sketch"), classes, out


def _salts_of() -> Column:
    """The salts that a class's rows have, as rows."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)).alias("salt")


def _shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and their row, ordered by row and hash."""
    hashes = words.hashes()
    at = places(words.bounds, width)
    code = [window_sums(hashes, width, seed=11)[at]]
    row = [np.searchsorted(words.bounds, at, "right") - 1]
    for short in range(1, width):
        few = np.flatnonzero(words.counts == short)
        if len(few):
            code.append(window_sums(hashes, short, seed=11 + short)[words.bounds[few]])
            row.append(few)
    code, row = np.concatenate(code), np.concatenate(row)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    return code[new], row[new]


def fill_bins(code: np.ndarray, row: np.ndarray, n_rows: int, bins: int) -> np.ndarray:
    """The sketch of each row: ``bins`` values, all filled where the row has an element."""
    empty = np.uint64(2**64 - 1)
    sketch = np.full(n_rows * bins, empty)
    for turn in range(2 * bins):
        if not len(code):
            break
        h = mix(code + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2**64))
        bin_ = (h % np.uint64(bins)).astype(np.int64) if turn < bins else np.full(len(code), turn - bins)
        # The round is the leading byte, so an earlier round always wins.
        value = (mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(9)) | (np.uint64(turn) << np.uint64(55))
        np.minimum.at(sketch, row * bins + bin_, value)
        open_ = (sketch.reshape(n_rows, bins) == empty).any(axis=1)
        left = open_[row]
        code, row = code[left], row[left]
    return sketch.reshape(n_rows, bins)


def fingerprints(code: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    """Two sums of scrambled shingle hashes of each row's set."""
    out = []
    for salt in (1, 2):
        total = np.zeros(n, np.uint64)
        np.add.at(total, row, mix(code ^ np.uint64(salt * 0x9E3779B9)))
        out.append(total)
    return out


def _sketch(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            code, row = _shingles(Words(part.column("text"), lower=True), width)
            n = part.num_rows
            size = np.bincount(row, minlength=n)
            sketch = fill_bins(code, row, n, bands * ROWS).reshape(n, bands, ROWS)
            band = np.zeros((n, bands), np.uint64)
            for k in range(ROWS):
                band = mix(band * np.uint64(31) + sketch[:, :, k])
            yield pa.record_batch(
                [
                    *(part.column(c) for c in ("doc_id", "key", "salt")),
                    pa.array(size.astype(np.int64)),
                    *(pa.array(p.view(np.int64)) for p in fingerprints(code, row, n)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)),
                        pa.array(band.reshape(-1).view(np.int64)),
                    ),
                    # A byte of each coordinate, for a first comparison.
                    _binary(sketch.astype(np.uint8), np.arange(n + 1) * bands * ROWS),
                ],
                ["doc_id", "key", "salt", "n", "f1", "f2", "bands", "sketch"],
            )

    return run


def _sets(width: int):
    """Sets of the rows that have the fingerprint of the class they came with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            code, row = _shingles(Words(part.column("text"), lower=True), width)
            n = part.num_rows
            own = [*(p.view(np.int64) for p in fingerprints(code, row, n)), np.bincount(row, minlength=n)]
            same = np.logical_and.reduce([part.column(c).to_numpy() == v for c, v in zip(PRINT, own, strict=True)])
            bounds = np.searchsorted(row, np.arange(n + 1)) * 8
            out = pa.record_batch([part.column("cls"), part.column("n"), _binary(code, bounds)], ["cls", "n", "shingles"])
            yield out.filter(pa.array(same))

    return run


def _binary(code: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(code.tobytes())]
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch.column("a"), batch.column("b"), []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(_linked(one, two, percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([a.filter(mask), b.filter(mask)], ["a", "b"])

    both = pairs.join(left, "a").select("a", "b", "x").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(two, one)
    at[at == len(two)] = 0
    inter = int(np.count_nonzero(two[at] == one)) if len(two) else 0
    return 100 * inter >= percent * (len(one) + len(two) - inter)


def _cross_links(named: DataFrame, sets: DataFrame, sketches: DataFrame, bins: int, percent: int) -> DataFrame:
    """Links between members of one bucket that are not in one component yet.

    Sketches come first: a member stays only if some other component's member in its bucket
    agrees with it in as many coordinates as a pair at the threshold does but for a chance
    below ``MISS``. The members that stay are compared on their full sets.
    """
    named = stored(named, "open-buckets")
    least = _least_agreement(bins, percent / 100)
    near = stored(
        _cells(named).join(sketches.select("cls", "sketch"), "cls")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_plausible(bins, least), "bucket long, cls long, n long, comp long"),
        "plausible-members",
    )
    rows = _cells(near.distinct()).join(sets.select("cls", "shingles"), "cls")
    found = stored(
        rows.repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_compare_sets(percent), "a long, b long")
        .distinct(),
        "cell-links",
    )
    release(named, near)
    return found


def _cells(named: DataFrame) -> DataFrame:
    """Members of buckets with several components, dealt to cells of two blocks each.

    Members of the bucket's largest component form the blocks from 0 down, the others those
    from 1 up; a row goes to the cells of its block with every block of the others, so a large
    component costs one row for each block outside it, however large the bucket is.
    """
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sized = named.groupBy("bucket", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    total = sized.groupBy("bucket").agg(
        F.max(F.struct("size", "comp", "shingles")).alias("major"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles")
    )
    outside = (F.col("size") - F.col("major.size")).alias("size"), (F.col("shingles") - F.col("major.shingles")).alias("shingles")
    mixed = total.select("bucket", F.col("major.comp").alias("main"), F.col("major.size").alias("ms"), F.col("major.shingles").alias("mn"), *outside)
    mixed = mixed.where("size > 0").select(
        "bucket",
        "main",
        blocks.alias("minor"),
        F.ceil(F.greatest(F.col("ms") / BLOCK, F.col("mn") / BLOCK_SHINGLES)).cast("int").alias("major"),
    )
    dealt = named.join(mixed, "bucket")
    block = F.when(F.col("comp") == F.col("main"), -F.pmod(F.xxhash64("cls"), "major")).otherwise(1 + F.pmod(F.xxhash64("cls"), "minor"))
    dealt = dealt.withColumn("block", block.cast("int"))
    others = F.when(F.col("block") > 0, F.sequence(1 - F.col("major"), "minor")).otherwise(F.sequence(F.lit(1), "minor"))
    spread = dealt.select("*", F.explode(others).alias("other"))
    return spread.select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "comp"
    )


def _least_agreement(bins: int, similarity: float) -> int:
    """The largest count that a pair at ``similarity`` falls short of with a chance below MISS."""
    below = 0.0
    for k in range(bins + 1):
        below += math.comb(bins, k) * similarity**k * (1 - similarity) ** (bins - k)
        if below > MISS:
            return k
    return bins


def _other_pairs(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, components, and which pairs of a cell are its to compare."""
    cls, comp, block = (cell.column(c).to_numpy() for c in ("cls", "comp", "block"))
    mine = comp[:, None] != comp[None, :]
    if cell.column("i")[0] != cell.column("j")[0]:
        mine &= block[:, None] != block[None, :]
    return cls, comp, mine


def _plausible(bins: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["bucket", "i", "j"]):
            cls, comp, mine = _other_pairs(cell)
            sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(-1, bins)
            agree = np.zeros(mine.shape, np.int16)
            for k in range(0, bins, 4):
                agree += (sketch[:, None, k : k + 4] == sketch[None, :, k : k + 4]).sum(axis=2, dtype=np.int16)
            some = np.flatnonzero((mine & (agree >= least)).any(axis=1))
            if len(some):
                bucket = np.full(len(some), cell.column("bucket")[0].as_py())
                n = cell.column("n").to_numpy()[some]
                yield pa.record_batch(
                    [pa.array(bucket), pa.array(cls[some]), pa.array(n), pa.array(comp[some])], ["bucket", "cls", "n", "comp"]
                )

    return run


def _compare_sets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["bucket", "i", "j"]):
            cls, _, mine = _other_pairs(cell)
            found = [np.frombuffer(v, np.uint64) for v in cell.column("shingles").to_pylist()]
            sizes = np.array([len(v) for v in found], np.int64)
            inter = common(found, np.concatenate(found), sizes)
            first = first_linked(mine & (100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)))
            moved = np.flatnonzero(first != np.arange(len(first)))
            yield pa.record_batch([pa.array(cls[first[moved]]), pa.array(cls[moved])], ["a", "b"])

    return run


def first_linked(linked: np.ndarray) -> np.ndarray:
    """For every member the first one that it reaches over links: a row a member says what a
    row a link would, and links of a cell grow with the square of its members."""
    n = len(linked)
    first = np.arange(n)
    while n:
        near = np.where(linked, first[None, :], n).min(axis=1)
        new = np.minimum(first, near)
        np.minimum.at(new, first, near)
        new = new[new]
        if (new == first).all():
            break
        first = new
    return first


def common(found: list[np.ndarray], merged: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all given sets, by slices of a 0/1 matrix."""
    n = len(found)
    total = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(merged, kind="stable")
    code, owner = merged[order], owner[order]
    number = np.cumsum(np.append(True, code[1:] != code[:-1])) - 1 if len(code) else code.astype(np.int64)
    at, width = 0, 4096
    while at < len(code):
        first = number[at]
        to = int(np.searchsorted(number, first + width))
        grid = np.zeros((n, width), np.float32)
        grid[owner[at:to], number[at:to] - first] = 1
        total += grid @ grid.T
        at = to
    return total.astype(np.int64)
