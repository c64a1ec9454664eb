"""Corpus pipeline over `documents`: each stage is written as Parquet and read again by the next.

1. language_id: documents whose language is unknown (no letters, or a score under 0.3) go.
2. line_dedup: later copies of three-line windows are cut; documents of which nothing is left go.
3. ngram_jaccard_join: one document of each group of near duplicates stays, the smallest doc_id.
4. decontamination: documents that hold a benchmark item go.
5. mixing: documents are drawn so that source, language and topic meet their target shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import decontaminate, language_id, line_dedup, mixing, near_duplicates
from factweave.llm.common import materialise, table


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text; a document goes only if lines were removed and no letter or digit is left."""
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs).select(*docs.columns)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("ngram_jaccard_join", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("mixing", stage_mix),
]
#: Training, banding and blocks cannot be told in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
