"""A corpus from raw documents: quality, near duplicates, benchmarks, privacy, mixture.

Each stage takes all that its predecessor kept, as a written table, and applies one operator;
all but the last return the columns of ``documents``, and so does the last.

Odd cases in every stage: null values of any column and very long texts are kept or judged by the
operator like others; repeated rows are rows of their own; an empty table gives an empty one;
further columns of any names stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stabilis.llm import decontaminate, jaccard_join, mixing, pii, quality
from stabilis.llm.common import checkpoint, forget, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; null and empty texts go, repeated rows share
    their fate, and without labels of both kinds all others stay."""
    return quality.classify(docs, read(spark, sf_dir, "labels")).filter("keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id (null last; of equal
    ids any one row); texts without words all stay."""
    return jaccard_join.keep_one(docs, 75)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts stay."""
    return decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars is that of the new text, null for null."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; a null source is one of its own,
    and texts without words may be taken too."""
    return mixing.emit_mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixture),
]

#: The learned classifier and the tiling have no SQL form; stages are tested against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder and reread; a
    table goes when the next one is written."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, checkpoint(stage(spark, docs, sf_dir))
        if k:
            forget(before)
    return docs
