"""Ranked text search by an index of trigrams: a pattern reads the postings of its rarest trigram, not all names.

The index is two tables, by buckets of the trigram's hash and sorted in them: postings (gram, id) and sizes (gram, n). What a
posting proposes is verified on the name. Patterns under three characters have no trigram and take the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS, LIMIT, GRAM = 64, 20, 3
#: So many patterns are told to tasks as literals and prune buckets; more meet the postings in a join.
TOLD = 1000


def _grams(text: Column) -> Column:
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: str = "gram") -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


class Trigrams:
    """An index under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, entity: DataFrame) -> None:
        """Indexes names and qualified names (id, name, qualified_name), whatever their case."""
        grams = F.array_union(_grams(F.lower("name")), _grams(F.lower("qualified_name")))
        postings = entity.select("id", F.explode(grams).alias("gram")).withColumn("bucket", _bucket())
        # a frequent trigram's postings are many rows: they are spread over tasks, a part file each
        postings.repartition(self._tasks(), "bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings")
        sizes = self.postings().groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        sizes.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/sizes")

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, id long, bucket int").parquet(f"{self.root}/postings")

    def sizes(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.root}/sizes")

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """query_id, id: what the postings of each pattern's rarest trigram propose. patterns: query_id, text, in lower case and
        of three characters or more."""
        asked = patterns.select("query_id", F.explode(_grams(F.col("text"))).alias("gram"))
        told = [r["gram"] for r in asked.select("gram").distinct().limit(TOLD + 1).collect()]
        sizes = self.sizes()
        if len(told) <= TOLD:
            sizes = sizes.where(F.col("bucket").isin(self._buckets(told)) & F.col("gram").isin(told))
        # a trigram that no name has finds nothing
        known = asked.join(sizes.select("gram", "n"), "gram", "left").groupBy("query_id").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("x"))
        rarest = known.where("x.n is not null").select("query_id", "x.gram")
        postings = self.postings()
        if len(told) <= TOLD:
            used = [r["gram"] for r in rarest.select("gram").distinct().collect()]  # TOLD at most
            postings = postings.where(F.col("bucket").isin(self._buckets(used)) & F.col("gram").isin(used))
        return rarest.join(postings.select("gram", "id"), "gram").select("query_id", "id")

    def _buckets(self, grams: list[str]) -> list[int]:
        """The buckets of trigrams (TOLD at most)."""
        if not grams:
            return []
        told = self.spark.range(1).select(F.explode(F.array(*(F.lit(g) for g in grams))).alias("gram"))
        return [r[0] for r in told.select(_bucket()).distinct().collect()]


def ranked_all(index: Trigrams, entity: DataFrame, patterns: DataFrame, n: int = LIMIT) -> DataFrame:
    """query_id, id, name, kind, rank, place: of each pattern (query_id, text) what `search.ranked` gives, in its order."""
    asked = patterns.select("query_id", F.lower(F.trim("text")).alias("q")).where("q <> ''")
    rows = entity.select("id", "name", "qualified_name", "kind")
    long_ = asked.where(F.length("q") >= GRAM)
    found = index.candidates(long_.select("query_id", F.col("q").alias("text"))).join(rows, "id").join(long_, "query_id")
    short = asked.where(F.length("q") < GRAM)
    holds = F.contains(F.lower("name"), F.col("q")) | F.contains(F.lower("qualified_name"), F.col("q"))
    hits = found.where(holds)
    if not short.isEmpty():
        hits = hits.unionByName(rows.join(short, holds).select(*found.columns))  # the scan, for the patterns without a trigram
    name = F.lower("name")
    rank = F.when(name == F.col("q"), 0).when(F.startswith(name, F.col("q")), 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", F.length("name"), "name", "id"))
    return hits.withColumn("rank", rank).withColumn("place", place).where(F.col("place") <= min(max(n, 1), 100)).select("query_id", "id", "name", "kind", "rank", "place")
