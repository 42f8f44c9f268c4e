"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpass.llm import (
    ann,
    exact_topk,
    importance,
    line_dedup,
    lm,
    manifest,
    mixing,
    near_dup,
    packing,
    pii,
    quality,
    substring_dedup,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]

REGISTERED: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_substring_dedup(spark, sf):
    cut = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_minhash_near_dedup(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents"), shingle=3, percent=85)


@query
def op1_entropy_mixing(spark, sf):
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op2_best_fit_packing(spark, sf):
    paths = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return packing.pack(table(spark, sf, "documents"), *paths)


@query
def op3_segment_topk(spark, sf):
    return exact_topk.exact_topk(table(spark, sf, "embeddings"))


@query
def op4_adaptive_scan_ann(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings"))


@query
def op6_context_mixing_lm(spark, sf):
    return lm.score_texts(table(spark, sf, "documents"))


@query
def op7_weak_label_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.fit(docs, table(spark, sf, "labels")).score(docs)


@query
def op9_semi_markov_pii(spark, sf):
    found = pii.find_personal_data(table(spark, sf, "documents"))
    kinds = F.array(*(F.lit(k) for k in pii.KINDS))

    def joined(spans):
        placed = F.transform(
            spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(kinds, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))
        )
        return F.array_join(
            F.transform(F.array_sort(placed), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ","
        )

    def count(kind):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.concat("base_spans", "added_spans")).alias("spans"),
        F.size("added_spans").cast("long").alias("n_added"),
    )


@query
def op5_log_template_line_dedup(spark, sf):
    cut = line_dedup.drop_recurring_lines(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_importance_resampling(spark, sf):
    drawn = importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# The rules of the query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op12_url_filter_cascade(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.ruled(table(spark, sf, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op13_merkle_manifest(spark, sf):
    proofs = manifest.merkle_manifest(
        table(spark, sf, "documents"),
        alter=F.crc32(F.col("doc_id").cast("string")) % 3 == 0,
        changes={"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)},
    )
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
