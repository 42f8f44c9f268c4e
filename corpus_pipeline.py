"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what a stage returns as
Parquet to the shared scratch folder and rereads it for the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass.llm import line_dedup, mixing, near_dup, packing, quality
from roadpass.llm.scratch import release, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near-duplicates share five-word shingles with a similarity of at least 0.8.
SHINGLE, PERCENT = 5, 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.fit(docs, labels).keep(docs)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents; n_chars follows the text."""
    cut = line_dedup.cut_lines(docs, sources=True)
    length = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("d.n_chars"))
    new = {"text": F.col("text"), "n_chars": length.cast(docs.schema["n_chars"].dataType)}
    return cut.select(*(new.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Documents are told apart by id and text, so unlike texts that share a doc_id all stay; of
    rows that repeat both one stays; rows without a doc_id stay.
    """
    key = line_dedup.row_key(F.col("doc_id"), F.coalesce("text", F.lit("")))
    rows = docs.where("doc_id is not null").select(F.struct("*").alias("d"), key.alias("key"))
    stay = near_dup.first_of_groups(rows.select("d.doc_id", "d.text", "key"), SHINGLE, PERCENT)
    kept = rows.join(stay.hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    return kept.select(*(F.col("d").getField(c).alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences of 2048 tokens."""
    paths = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(docs, *paths)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_filter),
    ("near_dedup", near_duplicate_filter),
    ("source_mixing", source_mix),
    ("packing", sequences),
]

# A trained classifier has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
