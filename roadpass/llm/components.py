"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpass.llm.scratch import release, stored, without


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is its smallest node.

    Labels move along links and then jump to their label's label, so the number of rounds
    follows the logarithm of the longest path in practice. Every round is written to the
    scratch folder; only a count reaches the driver. Null ends must be removed before.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("near"))
            .withColumnRenamed("a", "node")
        )
        moved = stored(
            labels.select("node", "component").join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")),
            "moved-labels",
        )
        above = moved.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = stored(
            moved.join(above, "component", "left").select("node", F.least("component", F.coalesce("above", "component")).alias("component"), "was"),
            "labels",
        )
        release(labels, moved)
        labels = jumped
        if labels.where("component <> was").isEmpty():
            release(both)
            return without(labels, "was")

