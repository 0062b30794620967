"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """id, label (the smallest id of its component) of every end of edges (a, b longs, neither null).

    Each round takes the least label among neighbours, then that label's own label, so long chains halve; tables written
    between rounds cut the lineage. An edge table without rows gives none.
    """
    both = edges.where("a <> b")
    both = written(spark, both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    loops = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("label"))
    labels = written(spark, both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b", "label": "near"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = written(spark, step.join(up, "label").select("id", "old", F.col("up").alias("label")))
        done = new.where("old <> label").isEmpty()
        labels = new.select("id", "label")
        if done:
            return labels.unionByName(loops.join(labels, "id", "left_anti").distinct())
