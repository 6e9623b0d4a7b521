"""From raw documents to token ids: the stages of the corpus pipeline, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may write it and read it again in between. All but
the last return the columns of ``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stockweave.llm import bpe, dedup, langid, mixing, partenum
from stockweave.llm.common import Stages

#: Classifiers and iterations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return langid.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text one stays."""
    return dedup.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return partenum.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken more or less often, so that the domains' tokens meet the targets."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed(docs, mixing.label_domains(labels), mixing.TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded bytes of every document that is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_jaccard", near_dedup), ("mixing", mix_sources), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is written below ``spark.checkpoint.dir`` and read again as the next one's input."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stages.put(name, stage(spark, docs, sf_dir))
    return docs
