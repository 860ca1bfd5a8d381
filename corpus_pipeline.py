"""A corpus from documents: rejects, exact copies and near copies go, sources are mixed, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrine.llm import exact, mixing, near, packing, quality
from kestrine.llm.common import fresh_path, removed


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the co-trained classifier doesn't reject; it is fitted on docs and the labels of sf_dir.

    Every row is scored, whatever is null, empty or long in it; without labels, or with labels of no row, nothing is rejected.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, but for the case of A-Z, the row with the largest doc_id stays (null if no other), of rows that repeat it one. Null counts as empty."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are joined by links of similarity 0.8 or more (five-word shingles) the row with the smallest doc_id stays.

    SimHash in tiles finds what is then checked exactly; op2's radius holds only about 0.96. Wordless and null texts are equal.
    """
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, 0 to 3 times; rows without words, and so null texts, are taken 0 times if their source has no words."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces, where they go and their ids. A document that the mix repeats is packed as often, each time elsewhere; null texts are one closing id."""
    return packing.packed(docs)


STAGES = [("quality classifier", good_quality), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("best-fit packing", pack)]

#: Classifier and tokeniser aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written in the shared folder, read again, and removed once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
