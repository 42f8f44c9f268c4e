"""Mixing sources to target weights by entropy balancing.

A document may be taken 0, 1 or 2 times. Among all distributions over copies the one
closest to the even prior in relative entropy, subject to each source's words adding up to
its target, tilts every document's prior exponentially by ``lambda * size``: a document of
relative size x is taken ``2 / (1 + exp(-lambda * x))`` times on average. ``lambda`` of each
source minimises the convex dual ``sum 2 log(1 + exp(lambda x)) - lambda T``.

1. Words are counted; (source, size) pairs with their number of documents are a complete
   summary of the dual.
2. Newton iterations run as Spark aggregations of gradient and curvature over that summary,
   all sources at once. A bracket of each root is kept; a step that leaves it halves it.
3. Rates are rounded into copies, from large documents to small ones: each size takes the
   whole number of copies nearest to its rates and the words missed so far. A size's copies
   are dealt evenly to its documents.

Edge cases: a null or wordless text has size 0 and takes nothing; a null source is a source
of its own, last in order; repeated rows are rounded one by one; a null ``doc_id`` is kept;
a source at its limit of 2 takes every document twice; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpass.llm.ranks import ranked
from roadpass.llm.scratch import release, stored
from roadpass.llm.words import WORD_PATTERN

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
TOLERANCE = 1e-7
MAX_ITERATIONS = 80


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    # Equal rows are told apart by nothing, so together they are taken as often as their sum.
    keyed = docs.select(F.struct("*").alias("d")).withColumn("row", F.xxhash64("d"))
    plain = docs.select("doc_id", "source", "text", F.xxhash64(F.struct("*")).alias("row"))
    copies = mix_sources(plain, weights, share, ["row"]).groupBy("row").agg(F.sum("copies").cast("int").alias("copies"))
    taken = stored(copies.where("copies > 0"), "copies")
    repeated = keyed.join(taken, "row").dropDuplicates(["row"]).select("d", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select("d.*")


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, carry: list[str] | None = None
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken for every row.

    Columns named in ``carry`` are added unchanged.
    """
    carry = carry or []
    sized = stored(
        docs.select(
            *carry,
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    summary = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-summary")
    targets = stored(source_targets(summary, weights, share), "targets")
    keyed = targets.select(F.col("source").alias("_source"), "source_no", "source_size", "target")
    summary = stored(
        summary.join(keyed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source"), "numbered-summary"
    )
    tilts = solve(summary)
    # Rounded, so that the order in which sums were added up cannot show.
    rates = summary.join(tilts, "source_no").withColumn(
        "rate", F.round(_rate(F.col("tilt"), F.col("size") / F.col("unit"), F.col("full")), 7)
    )
    classes = stored(
        rates.select("source_no", "size", "n", "rate")
        .groupBy("source_no")
        .applyInPandas(round_classes, "source_no int, size long, n long, rate double, extra long"),
        "class-copies",
    )
    rows = sized.join(keyed, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # A document's place among those of its source and size.
    placed = ranked(rows, ["source_no", "size"], ["doc_id"]).join(classes, ["source_no", "size"])
    # Each class spreads its copies evenly over its documents, in whole numbers.
    upto = F.expr("(rank + 1) * extra div n") - F.expr("rank * extra div n")
    return placed.select(
        *carry, "doc_id", "source", "size", "source_size", "target", "rate", upto.cast("int").alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def round_classes(rates: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size class of one source (column ``extra``).

    Large documents come first; the words that rounding missed are carried to the next
    smaller size, so what is left in the end is about half a small document. A source has
    at most sqrt(2 * its words) different sizes.
    """
    rates = rates.sort_values("size", ascending=False)
    carry, extra = 0.0, []
    for size, n, rate in zip(rates["size"].tolist(), rates["n"].tolist(), rates["rate"].tolist(), strict=True):
        wanted = carry + size * n * rate
        copies = min(LIMIT * n, max(0, math.floor(wanted / size + 0.5))) if size else 0
        carry = wanted - size * copies
        extra.append(copies)
    return rates.assign(extra=extra)


def source_targets(summary: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """source, source_no, source_size and target of each source.

    Sources in code point order, null last, weigh ``weights`` in turn. A source at its limit
    leaves the rest of its share to the others; sorted by limit per weight, the sources at
    their limits come first, and the first one below sets the common share per weight.
    One row per source; the ordered windows below see only these.
    """
    sizes = summary.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy(LIMIT * F.col("source_size") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        share * F.sum("source_size").over(everything)
        - F.coalesce(F.sum(LIMIT * F.col("source_size")).over(before), F.lit(0))
    ) / F.sum("weight").over(onwards)
    below = F.col("level") * F.col("weight") <= LIMIT * F.col("source_size")
    return (
        numbered.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("common", F.first(F.when(below, F.col("level")), ignorenulls=True).over(
            by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select(
            "source",
            "source_no",
            "source_size",
            F.least(F.coalesce(F.col("common"), F.lit(0.0)) * F.col("weight"), (LIMIT * F.col("source_size")).cast("double")).alias("target"),
        )
    )


def _rate(tilt: Column, x: Column, full: Column) -> Column:
    return F.when(full, F.lit(float(LIMIT))).otherwise(LIMIT / (1 + F.exp(-tilt * x)))


def solve(summary: DataFrame) -> DataFrame:
    """source_no, tilt, unit (the source's mean size) and full (target at the limit).

    ``summary`` holds source_no, source_size, target, size and n.
    """
    per_source = summary.groupBy("source_no").agg(
        F.first("target").alias("target"),
        F.first("source_size").alias("source_size"),
        F.greatest(F.sum(F.col("size") * F.col("n")) / F.sum("n"), F.lit(1.0)).alias("unit"),
    )
    odds = F.col("target") / (LIMIT * F.col("source_size") - F.col("target"))
    full = (F.col("source_size") == 0) | (F.col("target") >= LIMIT * F.col("source_size"))
    state = stored(
        per_source.withColumn("full", full)
        .withColumn("tilt", F.when(F.col("full"), F.lit(0.0)).otherwise(F.log(odds)))
        .withColumn("low", F.lit(None).cast("double"))
        .withColumn("high", F.lit(None).cast("double")),
        "tilts",
    )
    for _ in range(MAX_ITERATIONS):
        x = F.col("size") / F.col("unit")
        rate = _rate(F.col("tilt"), x, F.col("full"))
        sums = (
            summary.drop("target", "source_size")
            .join(state, "source_no")
            .groupBy("source_no")
            .agg(
                F.sum(F.col("n") * rate * F.col("size")).alias("words"),
                F.sum(F.col("n") * rate * (1 - rate / LIMIT) * x * F.col("size")).alias("curve"),
            )
        )
        gap = F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("words") - F.col("target"))
        low = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.col("gap") / F.col("curve")
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high")))
        step = (
            F.when(F.col("gap") == 0, F.col("tilt"))
            .when((F.col("curve") > 0) & inside, newton)
            .when(F.col("low").isNull(), F.col("high") - 1 - F.abs("high"))
            .when(F.col("high").isNull(), F.col("low") + 1 + F.abs("low"))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        moved = stored(
            state.join(sums, "source_no")
            .withColumn("gap", gap)
            .withColumn("low", low)
            .withColumn("high", high)
            .withColumn("tilt", step),
            "tilts",
        )
        release(state)
        state = moved.select("source_no", "target", "source_size", "unit", "full", "tilt", "low", "high")
        state.scratch_path = moved.scratch_path
        worst = moved.agg(F.max(F.abs("gap") / F.greatest("target", F.lit(1.0)))).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"targets missed by {worst} of their size after {MAX_ITERATIONS} steps")
    return state.select("source_no", "tilt", "unit", "full")
