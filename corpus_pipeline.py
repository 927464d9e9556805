"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm._common import stored, table
from fieldloom.llm.bpe import encode_documents
from fieldloom.llm.line_dedup import dedup_documents
from fieldloom.llm.mixing import mix_documents
from fieldloom.llm.simhash import one_of_each
from fieldloom.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches 0.5 go."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that repeat an earlier line, up to one edit; no document goes."""
    return dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (Jaccard similarity of 0.8 or more of five-word shingles)."""
    return one_of_each(docs, 5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated and cut to their target weights."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the text decoded from them.

    A small cache that ends with the task: the stages before have filled the executors' heap, and those of the next run follow."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True, digests=True, cache=30_000_000, lasting=False)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express the stages' models, hashes and merges; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
