"""The training-data pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Every stage takes an empty table to an empty one and carries further columns through, whatever their names, but packing,
which returns rows of its own.  Null and empty texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import mixing, near_dedup, packing, quality_rules, storage, substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null and empty texts fail, repeated rows are judged alike."""
    return quality_rules.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of least id (null ids last); of equal rows one stays."""
    return near_dedup.deduplicated(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier text has; texts that lose all words go, equal rows keep one copy."""
    return substring_dedup.cleaned_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null sources are one source, equal rows go together, texts without words may stay or go."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its bin; texts without words keep a row without a bin, repeated rows are packed apart."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("near-dedup", near), ("substring dedup", substrings), ("mixing", mix), ("packing", pack)]

#: BagMinHash signatures cannot be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.written(docs, name.replace(" ", "-"))
    return docs
