"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Each stage works on all its predecessor kept and returns the columns of documents; the last returns the token
store's digest (doc_id, start, n_tokens, ids_crc32, intact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import staged, table, visible
from factloom.llm.decontaminate import remove_benchmark
from factloom.llm.langid import keep_languages
from factloom.llm.mixing import mix_documents
from factloom.llm.neardup import drop_near_duplicates
from factloom.llm.queries import word_bpe
from factloom.llm.token_store import op10_token_store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of which no language holds half, go."""
    visible(spark)
    return keep_languages(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the lowest doc_id."""
    visible(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go (coverage limit 0)."""
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, a row for each document and pass."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's digest of the mix, read back from its files."""
    visible(spark)
    return op10_token_store(docs, word_bpe())


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: Hashing, expectation-maximisation and tokenisation are not SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
