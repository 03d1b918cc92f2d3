"""The corpus pipeline over `documents`: five stages, each one of the training-data operators.

Each stage takes all documents that the one before kept, as (spark, docs, sf_dir), and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import bpe, decontaminate, simhash, substrings, toxicity
from kgloom.llm.common import MADE, forget, shared_dir, table
from kgloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8 or more) the smallest doc_id stays."""
    return simhash.first_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that stand anywhere else are cut out; every document stays."""
    return substrings.deduplicated(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows are cut out; documents that are mostly such words go."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and the digests of ids and of the decoded text."""
    return bpe.encoded(docs, tokenizer_path(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("bpe", encode_tokens),
]

#: SQL can't express the stages (a trained model, 64-bit fingerprints, merges); tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; a stage's own tables go when it is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = len(MADE)
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        forget(spark, before)
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
