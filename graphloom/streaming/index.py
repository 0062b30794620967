"""The chunk index as a table of versions, maintained by a stream of re-sent chunks and removed paths.

Each micro-batch is planned against the latest version by joins and written as the next one; a version is named by the
batch's number, so a batch that is run again after a failure writes the same version. Readers take the latest complete
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.incremental import index_counts, index_plan, upsert_index

CHUNKS = "id string, path string, hash string, text string"
#: What a stream brings: kind is `chunk` or `removed` (then only path counts).
EVENTS = f"kind string, {CHUNKS}"


def _hadoop(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, at: str) -> list[int]:
    """Numbers of the complete versions."""
    fs, path = _hadoop(spark, at)
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(done):
            found.append(int(name[2:]))
    return sorted(found)


def current(spark: SparkSession, at: str, before: int | None = None) -> DataFrame:
    """The latest version (earlier than `before`), or an empty table."""
    known = [v for v in versions(spark, at) if before is None or v < before]
    return spark.read.schema(CHUNKS).parquet(f"{at}/v={known[-1]}") if known else spark.createDataFrame([], CHUNKS)


def apply(events: DataFrame, number: int, at: str) -> None:
    spark = events.sparkSession
    sent = events.where("kind = 'chunk'").dropDuplicates(["id"]).select("id", "path", "hash", "text")
    removed = events.where("kind = 'removed'").select("path").distinct()
    stored = current(spark, at, before=number)
    plan = index_plan(stored, sent, removed)
    upsert_index(stored, sent, plan).write.mode("overwrite").parquet(f"{at}/v={number}")


def maintain(events: DataFrame, at: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream; trigger as for DataStreamWriter.trigger, all that is there by default."""
    return events.writeStream.foreachBatch(lambda batch, number: apply(batch, number, at)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def report(stored: DataFrame, sent: DataFrame, removed: DataFrame, reset: bool = False) -> DataFrame:
    """added, skipped, removed, total of one update."""
    return index_counts(index_plan(stored, sent, removed, reset))


def activity_by_hour(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Runs by hour and status from a stream of runs (started_at timestamp, status), with a watermark for late ones."""
    return runs.withWatermark("started_at", late).groupBy(F.window("started_at", "1 hour").alias("hour"), "status").agg(F.count("*").alias("n")).select(F.col("hour.start").alias("hour"), "status", "n")
