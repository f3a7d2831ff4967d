"""The corpus pipeline: documents through the stages below, each written and reread.

Every stage but the last returns the columns of ``documents``; extra columns of any name keep
their values; an empty table stays empty; repeated rows are rows of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import decontaminate, mixing, near_dups, token_ids, toxicity
from veldspar.session import table, written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay unchanged, null and empty texts as the bias says."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the least id (null last, then by place); texts without words all stay."""
    return near_dups.kept(docs)


def remove_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts, and texts of which they are more than half go; null texts stay."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source near its target; documents may be repeated up to three times; null is a source, and ties go by a hash."""
    return mixing.draw(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded in id order (null first), written as Simple-8b blocks and read back; null and empty texts are their end id."""
    return token_ids.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("MinHash near-dedup", remove_near_copies),
    ("benchmark decontamination", remove_test_passages),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_token_ids),
]

#: The stages are not expressible in SQL; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
