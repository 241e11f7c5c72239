"""The corpus pipeline: five stages, each written as Parquet and read again.

1. quality: documents unlike the labelled good ones go (importance resampling);
2. exact: one document of each group of equal texts stays;
3. near: one document of each near-duplicate component stays (five-word
   shingles, similarity 0.8 or more);
4. private: personal data become consistent surrogates;
5. pack: documents become sequences whose lengths are powers of two.

Stages 1 to 4 return the columns of ``documents``; stage 5 returns pieces.
Every stage works on all its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, near_dedup, packing, pii, quality
from tidemark.session import stage_table

#: The vocabulary that the last stage packs with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier samples."""
    return quality.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without exact copies."""
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without near copies."""
    return near_dedup.drop_near_copies(docs)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.pseudonymise(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents: doc_id, start, length, ids, doc_tokens,
    bucket, sequence_id, offset."""
    return packing.pack(docs, TOKENIZER)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("private", private_stage), ("pack", pack_stage)]

#: MinHash components and importance sampling have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to
    the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
