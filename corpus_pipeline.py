"""A corpus pipeline: drop toxic documents, drop bad ones, keep one of each group of near-duplicates, pack the rest.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result as Parquet in the shared
folder and reads it back as the next one's documents, so a lost executor costs one stage at most.  All stages but the last
return the rows they keep with all columns of ``docs``.  No documents, and no documents left, pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changegate.llm import near_copies, packing, quality, toxicity
from changegate.llm.common import cut_lineage, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, learned from the labels outside the held-out fold, does not predict toxic."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior quality, given all rules' votes, is at least one half."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.keep_distinct(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_bad), ("SimHash near-dedup", drop_near_duplicates), ("packing", pack)]

# A trained tagger has no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for position, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES):
            docs = cut_lineage(docs)
    return docs
