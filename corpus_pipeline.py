"""The corpus pipeline: quality rules, fuzzy line deduplication, SimHash near-duplicates, source mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of documents; the
last returns the packed pieces. run() writes each stage's rows as Parquet below spark.checkpoint.dir and reads them back, so a
lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import lines, mixing, neardup, packing, quality
from tessera.llm.common import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go. Null texts go; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of near lines stays; documents left without a line with a word go."""
    return lines.keep_unique_lines(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: five-word shingles at a similarity of 0.8
    or more. SimHash alone can't find these (README), so MinHash completes its links and exact sets verify all."""
    return neardup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are cut to the words that the mix takes and repeated as often; documents without one go."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mix_sources", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizing and MinHash have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
