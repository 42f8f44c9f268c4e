"""A Merkle manifest of a dataset with persistent versions for altered rows.

A row's leaf is the SHA-256 of its fields, each ``-`` where null, else its UTF-8 length, a
colon and its value. In each group leaves ascend by the order column; every ``FANOUT``
consecutive nodes become the SHA-256 of their digests as hex text, until one is left, the
group's subroot. Subroots, by group, become the root in the same way.

Nodes are handled in aligned blocks of ``FANOUT ** BLOCK_LEVELS``, so the largest group is
spread like any other. Going up, each block yields one node of the next, much smaller layer.
Going down, each block is told what stands left and right of its root's path on all levels
above (its context) and tells the blocks below.

A version for an altered leaf is made by path copying: the block's tree is never changed, a
version copies the ancestors of its leaf inside the block and shares all other nodes, and
its copied block root goes on through the blocks above by the context, which all
versions of the block share. Folded with the siblings, that is the version's own root.

Edge cases: null groups come first, then groups by their UTF-8 bytes; null order values come
first and equal ones ascend by leaf, so repeated rows stand side by side and each has a proof
of its own; null and empty values differ (``-`` and ``0:``); a lone leaf is its own
subroot, a lone subroot the root, both with an empty proof; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpass.llm.groups import runs
from roadpass.llm.positions import positions
from roadpass.llm.scratch import release, stored

FANOUT = 8
BLOCK_LEVELS = 4
SPAN = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "tree long, n long, pos long, digest binary"
CONTEXT = "tree long, pos long, context string"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, altered boolean"


def merkle_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    alter: Column | None = None,
    changes: dict[str, Column] | None = None,
) -> DataFrame:
    """One row a leaf: doc_id (the order column), leaf, subroot, root, proof_sha256,
    folded_root, verified and altered.

    Rows for which ``alter`` holds get a version with the fields of ``changes`` replaced, and
    folded_root is that version's root; it is the root itself for all others.
    """
    changed = F.lit(None).cast("binary")
    if alter is not None and changes:
        other = leaf_digest([changes.get(f, F.col(f)) for f in fields])
        changed = F.when(alter, other)
    rows = docs.select(
        F.col(order).cast("long").alias("doc_id"),
        F.col(group).alias("_group"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        changed.alias("changed"),
    )
    leaves = stored(rows, "leaves")
    placed = positions(leaves, [F.asc_nulls_first("_group"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc_nulls_first("changed")])
    release(leaves)
    sizes = stored(placed.groupBy("_group").agg(F.count("*").alias("n"), F.min("position").alias("_first")), "group-sizes")
    groups = positions(sizes, [F.asc_nulls_first("_group")])
    named = groups.select(F.col("_group").alias("_name"), F.col("position").alias("tree"), "n", "_first")
    nodes = stored(
        placed.join(named, F.col("_group").eqNullSafe(F.col("_name"))).select(
            "tree", "n", (F.col("position") - F.col("_first")).alias("pos"), "digest", "doc_id", "changed"
        ),
        "tree-leaves",
    )
    release(placed, sizes)
    layers = _layers(nodes)
    total = groups.count()
    subroots = stored(
        layers[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), F.col("tree").alias("pos"), "digest"),
        "subroots",
    )
    tops = _layers(subroots)
    top = tops[-1].select("tree", "pos", F.lit("").alias("context"))
    for layer in reversed(tops[:-1]):
        top = _blocks(layer, top).mapInArrow(_down, CONTEXT)
    # What stands beside each subroot becomes the context of the group's tree.
    context = stored(top.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "context"), "subroot-contexts")
    for layer in reversed(layers[1:-1]):
        context = _blocks(layer, context).mapInArrow(_down, CONTEXT)
    proofs = stored(_blocks(nodes, context, "doc_id", "changed").mapInArrow(_prove, PROOF), "proofs")
    release(nodes, groups, subroots, *layers[1:], *tops[1:])
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the fields' lengths and values, as bytes."""
    texts = [v.cast("string") for v in values]
    named = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*named), 256))


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, then one node a block, and so on until every tree has one node.

    The last layer stands for the roots; a table of lone nodes is its own last layer twice.
    """
    layers = [nodes]
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while True:
        layers.append(stored(_blocks(layers[-1]).mapInArrow(_up, NODE), "layer"))
        most = -(-most // SPAN)
        if most <= 1:
            return layers


def _blocks(layer: DataFrame, context: DataFrame | None = None, *more: str) -> DataFrame:
    """A layer dealt by aligned blocks; a block's context comes as a row before its nodes."""
    columns = ["tree", F.expr(f"pos div {SPAN}").alias("block"), "n", "pos", "digest", *more]
    rows = layer.select(*columns, F.lit(None).cast("string").alias("context"))
    if context is not None:
        above = context.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "context")
        rows = rows.unionByName(above, allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def height(n: int) -> int:
    """How many levels a tree of ``n`` leaves has above them."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Block:
    """The unchanging nodes of an aligned block, level by level from the given ones."""

    def __init__(self, digests: list[str], n: int):
        self.levels = [digests]
        for _ in range(min(BLOCK_LEVELS, height(n))):
            below = self.levels[-1]
            self.levels.append([_digest(*below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def beside(self, level: int, i: int) -> tuple[str, str]:
        """The digests left and right of a node within its run."""
        first = i - i % FANOUT
        run = self.levels[level]
        return "".join(run[first:i]), "".join(run[i + 1 : first + FANOUT])

    def paths(self, above: str) -> Iterator[str]:
        """For each given node, what stands left and right of its path, up to the root."""
        known = [above]
        for level in range(len(self.levels) - 2, -1, -1):
            known = [
                ";".join(filter(None, ("|".join(self.beside(level, i)), known[i // FANOUT]))) for i in range(len(self.levels[level]))
            ]
        yield from known

    def version(self, i: int, digest: str) -> list[str]:
        """The nodes that a version with another leaf ``i`` copies, from the leaf to the block's root."""
        copied = [digest]
        for level in range(len(self.levels) - 1):
            left, right = self.beside(level, i)
            copied.append(_digest(left, copied[-1], right))
            i //= FANOUT
        return copied


def upwards(digest: str, context: str) -> list[str]:
    """The nodes above one, given what stands left and right of them."""
    out = [digest]
    for beside in filter(None, context.split(";")):
        left, right = beside.split("|")
        out.append(_digest(left, out[-1], right))
    return out


def _read(group: pa.Table) -> tuple[Block, str | None, pa.Table]:
    """A block, its context and its nodes' rows."""
    context = None
    if group.column("pos")[0].as_py() < 0:
        context = group.column("context")[0].as_py()
        group = group.slice(1)
    digests = [d.hex() for d in group.column("digest").to_pylist()]
    return Block(digests, group.column("n")[0].as_py()), context, group


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["tree", "block"]):
        block, _, rows = _read(group)
        n = -(-rows.column("n")[0].as_py() // SPAN)
        row = [[rows.column("tree")[0].as_py()], [n], [rows.column("block")[0].as_py()], [bytes.fromhex(block.root)]]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(row, (*[pa.int64()] * 3, pa.binary()), strict=True)], ["tree", "n", "pos", "digest"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["tree", "block"]):
        block, context, rows = _read(group)
        out = pa.table(
            {"tree": rows.column("tree"), "pos": rows.column("pos"), "context": pa.array(list(block.paths(context)), pa.string())}
        )
        yield from out.combine_chunks().to_batches()


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["tree", "block"]):
        block, context, rows = _read(group)
        levels = height(rows.column("n")[0].as_py())
        inside = len(block.levels) - 1
        above = upwards(block.root, context)
        subroot, root = above[levels - inside], above[-1]
        proofs, folded = [], []
        for i, (path, changed) in enumerate(zip(block.paths(context), rows.column("changed").to_pylist(), strict=True)):
            proofs.append(_digest(path.replace("|", "").replace(";", "")))
            folded.append(root if changed is None else upwards(block.version(i, changed.hex())[-1], context)[-1])
        count = rows.num_rows
        columns = [
            rows.column("doc_id").combine_chunks(),
            pa.array(block.levels[0], pa.string()),
            pa.array([subroot] * count, pa.string()),
            pa.array([root] * count, pa.string()),
            pa.array(proofs, pa.string()),
            pa.array(folded, pa.string()),
            pa.array([c is not None for c in rows.column("changed").to_pylist()], pa.bool_()),
        ]
        yield pa.record_batch(columns, [f.split()[0] for f in PROOF.split(", ")])
