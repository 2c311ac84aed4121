"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import decontaminate, exact_topk, hard_negatives, jaccard_join, language_id, licenses, lm_score, mixing, periodic_runs, pii, quality, simhash_dedup, suffix_dedup
from .common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").mapInArrow(
        suffix_dedup.digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = language_id.identify(docs, docs.filter(~language_id.held_out()))
    return told.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "content_score", "metadata_score", "score", "keep")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard_join.near_duplicates(read(spark, sf_dir, "documents"), 75)
    return jaccard_join.least_ids(members)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return exact_topk.top_k(rows.filter("id % 50 = 0"), rows, 5)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "item_id", "coverage", "contaminated")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score_texts(docs, ~lm_score.held_out())
    return scored.select("doc_id", lm_score.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.document_paths(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return licenses.scan(files, keep=["doc_id", "path"]).select("doc_id", "path", "license", F.round("cosine", 6).alias("cosine"), "origin", "declared_in")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = simhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(read(spark, sf_dir, "documents"), change=periodic_runs.repeating)
    return periodic_runs.digests(found).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_topk": op6_exact_topk,
    "op7_decontaminate": op7_decontaminate,
    "op8_lm_score": op8_lm_score,
    "op9_pii": op9_pii,
    "op10_licenses": op10_licenses,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE: dict[str, str] = {"op1_suffix_dedup": suffix_dedup.ORACLE, "op2_mixing": mixing.ORACLE, "op5_jaccard_join": jaccard_join.ORACLE, "op6_exact_topk": exact_topk.ORACLE, "op10_licenses": licenses.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
