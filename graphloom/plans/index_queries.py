"""Retrieval from indexes: the rows of the full products, from what can matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import keywords
from graphloom.operators.balls import Balls
from graphloom.plans.registry import registry
from graphloom.plans.retrieval_queries import ALL_KEYWORD_SQL, chunks
from graphloom.plans.retrieval_queries import ORACLES as RETRIEVAL
from graphloom.tables import table

QUERIES, ORACLES, query = registry()


@query(RETRIEVAL["dense_topk_all"])
def dense_topk_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, by balls round pivots."""
    v = table(spark, sf_dir, "embeddings")
    return Balls(spark, v).top(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)[0]


@query(f"WITH {ALL_KEYWORD_SQL} SELECT query_id, id, keyword FROM keyword WHERE keyword > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, id) <= 10")
def keyword_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks by keywords for every question of the benchmark, by inverted lists."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")
    return keywords.top(chunks(spark, sf_dir), asked, 10)[0]
