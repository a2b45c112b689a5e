"""The corpus pipeline: each stage works on all that the one before it kept.

Nulls and empty texts go with the first stage, as they have no letter. Repeated rows and rows without doc_id are rows like any
other until the near-duplicate stage, which keeps one row of each group. Very long texts are worked on whole, and columns
beside those of ``documents`` are carried along up to the packing, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import language_id, line_dedup, near_copies, packing, quality
from storyloom.llm.queries import SITES
from storyloom.llm.store import cut, drop, small_batches


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language that the documents' own labels teach, go."""
    small_batches(spark)
    model = language_id.fit(docs)
    return docs.filter(~language_id.prediction(model, F.col("text"))["rejected"])


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go. It learns from the labels."""
    small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.scored(model, F.col("text")) >= 0.3)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least SITES sources share are taken out. All documents stay, and n_chars follows the text."""
    counts = line_dedup.free_name("counts", docs.columns)
    found = line_dedup.strip(docs, SITES, counts=counts)
    return found.withColumn("n_chars", F.when(F.col(counts)["removed"] > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(counts)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8) stays: that of the smallest doc_id.

    The candidates are SimHash links by anchors (operator 10) and, as 0.8 lies beyond their reach, wider keys; see
    :mod:`storyloom.llm.near_copies`.
    """
    small_batches(spark)
    return near_copies.keep_first(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of up to 2048 tokens, their ids included."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", stage_language),
    ("quality classifier", stage_quality),
    ("line dedup", stage_lines),
    ("SimHash near-dedup", stage_near_dedup),
    ("packing", stage_packing),
]

#: SQL expresses neither the classifiers nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = cut(stage(spark, docs, sf_dir), f"stage{k}")
        drop(docs)  # the table of the stage before, which nothing reads any more
        docs = done
    return docs
