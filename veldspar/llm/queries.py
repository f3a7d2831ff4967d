"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm import decontaminate, hard_negatives, licenses, merkle, mixing, near_dups, perplexity, suffixes, token_ids, topk, toxicity, urls, vector_dups
from veldspar.session import table


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for page outcomes by equal id: bad is low quality or toxic."""
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.judged(table(spark, sf_dir, "pages"), outcomes)


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mixed(table(spark, sf_dir, "documents")))


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scanned(table(spark, sf_dir, "documents")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.deduplicated(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


def op13_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.grouped(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_decontaminate, op3_url_filter, op4_near_dups, op5_mix_sources, op6_perplexity, op7_token_ids, op8_toxicity, op9_licenses, op10_suffix_dedup, op11_merkle_manifest, op12_hard_negatives, op13_embedding_dups)}

#: Queries without SQL here are held against brute force, exact round trips or held-out accuracy in the tests.
ORACLES = {"op1_top_k": topk.ORACLE, "op3_url_filter": urls.ORACLE, "op5_mix_sources": mixing.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_embedding_dups": vector_dups.ORACLE}
