"""Corpus pipeline over ``documents``: toxicity, exact and near duplicates, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage as Parquet in the shared folder and reads it as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonalyze.llm import bpe, exact_dedup, mix, simhash, toxicity
from clonalyze.llm.common import staged, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHINGLE, MAX_BITS = 3, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal severity model, fitted on ``labels``, doesn't reject."""
    grades = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, grades))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal after white space normalisation, the one with the smallest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (3-word shingles, 2 bits), the document with the smallest doc_id."""
    return simhash.simhash_dedup(docs, shingle=SHINGLE, tau=MAX_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it (0, 1 or 2 times)."""
    return mix.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with the digests of ids and decoded bytes."""
    return bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", tokenise),
]

#: A fitted classifier and XXH64 have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
