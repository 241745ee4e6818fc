"""The registered query of each operator: production parameters, the whole table, the whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changegate.llm import byte_bpe, cover_tree, html_text, line_quality, packing, periodic_runs, quality, sharding, simhash
from changegate.llm import token_count, toxicity, url_filter, whitening
from changegate.llm.common import read_table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(read_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(read_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_topk, op3_token_counts, op4_byte_bpe, op5_quality_rules, op6_html_text, op7_sharding, op8_toxicity,
        op9_simhash, op10_packing, op11_quality_classifier, op12_whitening, op13_periodic_runs,
    )
}

# Where SQL has no such operation, the query has no entry here; tests hold it against a brute-force version.
ORACLES = {"op1_url_filter": url_filter.oracle_sql(), "op2_topk": cover_tree.oracle_sql()}
