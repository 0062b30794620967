"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return the
columns of documents; the mix has a row for each time it takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import jaccard_join, line_dedup, mixing, quality, sentencepiece_codec
from graphloom.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least a half and that pass the base rule."""
    return quality.keep_good(spark, docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one equals or is an edit away from."""
    return line_dedup.drop_lines(spark, docs, counts=False)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.keep_one(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, mixing.mix(spark, docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, round_trip."""
    return sentencepiece_codec.encode(spark, docs, keep=("doc_id", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", join_near_duplicates),
    ("mixing sources", mix_sources),
    ("sentencepiece encoding", encode),
]

#: Expectation-maximisation and the join have no form in SQL: tests/llm/test_pipeline.py checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; tables written in between cut the lineage."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(spark, docs), sf_dir)
    return docs
