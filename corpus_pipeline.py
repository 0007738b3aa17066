"""A corpus pipeline: language, quality, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. What it returns is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docaudit.llm import bpe, jaccard, langid, mixture, quality
from docaudit.llm.common import Scratch, table

#: Least score with which a document's language has to be told. One language of four has 0.25 by chance.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those of no language that the model can tell."""
    return langid.keep(docs, langid.fit(docs), LEAST_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rule or are anomalous by the forest."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8."""
    return jaccard.keep_one(docs, n=5, threshold=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixture.mix(docs).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of each document's ids and of what they decode to."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Forests, kernels and byte pairs can't be written in SQL; tests hold run() against the stages' plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
