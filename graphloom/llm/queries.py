"""The corpus operators as queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe_codec, embedding_dedup, jaccard_join, line_dedup, mixing, quality, sentencepiece_codec, sharding, spelling, substring_dedup, token_alignment, toxicity
from graphloom.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(spark, table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(spark, table(spark, sf_dir, "documents")).drop("rk")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_word_windows(spark, table(spark, sf_dir, "documents")).drop("removed")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_lines(spark, table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_byte_strings(spark, table(spark, sf_dir, "documents")).drop("removed")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).drop("rk")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(spark, table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode(spark, table(spark, sf_dir, "documents"), packed=True, decoded=True)
    digest = lambda c: F.sha2(F.coalesce(F.col(c).cast("binary"), F.lit(b"")), 256)
    return coded.select("doc_id", "n_tokens", digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spark, spelling.extract(table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda groups: F.when(groups == "", F.lit("")).otherwise(F.sha2(groups, 256))
    return token_alignment.align(spark, table(spark, sf_dir, "documents"), shape=sha).withColumnRenamed("groups", "groups_sha256")



QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_ngram_jaccard_join, op3_embedding_near_dedup, op4_substring_dedup, op5_line_dedup, op6_suffix_array_dedup, op7_source_mixing, op8_quality_rules, op9_sharding, op10_toxicity, op11_bpe_codec, op12_spelling_variants, op13_token_alignment)}
ORACLES = {
    "op2_ngram_jaccard_join": jaccard_join.oracle(), "op3_embedding_near_dedup": embedding_dedup.oracle(), "op4_substring_dedup": substring_dedup.oracle_words(), "op5_line_dedup": line_dedup.oracle(),
    "op6_suffix_array_dedup": substring_dedup.oracle_bytes(), "op7_source_mixing": mixing.oracle(), "op9_sharding": sharding.oracle(), "op12_spelling_variants": spelling.oracle(),
}
