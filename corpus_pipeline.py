"""Corpus pipeline: quality filter, near-duplicate removal, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexground.llm import decontam, neardup, packing, phrases, quality
from lexground.llm.common import materialise

#: SQL can't express the classifier.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.3 or more). Null and empty texts are judged by their statistics, rows that
    repeat alike; without labels all scores are equal. Long texts are scored whole."""
    return quality.accept(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id, once; null texts and texts without a word all stay."""
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out; ``n_chars``, if there is such a column, follows the
    text. Null ids are the largest; no row is dropped."""
    cut = phrases.deduplicate(docs)
    if "n_chars" not in docs.columns:
        return cut
    old = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.char_length("text").cast(old))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark windows; null and empty texts stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null or empty text is one token."""
    return packing.pack(packing.pieces(docs, *packing.public_paths()))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of what all stages keep of ``documents`` is packed. Empty tables give an empty result; extra columns of
    the documents pass through all stages but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
