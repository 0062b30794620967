"""Change sets and in-place maintenance: what an edit of some files means for stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import merge_edges


def change_set(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """path, change (added, changed, deleted) of two tables (path, sha256)."""
    both = stored.select("path", F.col("sha256").alias("old")).join(scanned.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def dependents(entity: DataFrame, edge: DataFrame, files: DataFrame) -> DataFrame:
    """file_id of files with edges into entities of the files given, without these."""
    hit = entity.join(files.select("file_id").distinct(), "file_id", "left_semi").select(F.col("id").alias("dst"))
    return edge.join(hit, "dst", "left_semi").select("file_id").distinct().join(files.select("file_id"), "file_id", "left_anti")


def waiting(unresolved: DataFrame, added: DataFrame, files: DataFrame) -> DataFrame:
    """file_id of unchanged files whose unresolved names (file_id, name) an added type (name) now resolves."""
    return unresolved.join(added.select("name").distinct(), "name", "left_semi").select("file_id").distinct().join(files.select("file_id"), "file_id", "left_anti")


def upsert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both; weights of equal ones add up."""
    return merge_edges(stored.select("src", "dst", "type", "weight").unionByName(new.select("src", "dst", "type", "weight")))


def patch_entities(stored: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities (id, qualified_name, file_id, ...) after an edit: those of removed or rewritten files (gone: file_id) give way to
    fresh ones (without ids), which keep the id of a known qualified name and get a hash of it otherwise."""
    known = stored.select("qualified_name", F.col("id").alias("known_id"))
    kept = stored.join(gone.select("file_id").distinct(), "file_id", "left_anti")
    new = fresh.join(known, "qualified_name", "left").withColumn("id", F.coalesce("known_id", F.xxhash64("qualified_name"))).drop("known_id")
    return kept.unionByName(new.select(*stored.columns))


def patch_edges(stored: DataFrame, fresh: DataFrame, files: DataFrame, entity: DataFrame) -> DataFrame:
    """Edges (src, dst, type, weight, file_id) after an edit: those that the files (file_id) gave go, as do those whose ends are
    gone; fresh ones come in."""
    kept = stored.join(files.select("file_id").distinct(), "file_id", "left_anti")
    both = kept.unionByName(fresh.select(*stored.columns))
    ids = entity.select("id")
    return both.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def index_plan(stored: DataFrame, sent: DataFrame, removed: DataFrame, reset: bool = False) -> DataFrame:
    """id, action (added, skipped, removed) of chunks (id, path, hash) when some are sent and paths are removed.

    Chunks of removed paths go, and those of paths sent again that were not sent with them. With reset, all stored go.
    """
    if reset:
        stored = stored.limit(0)
    old = stored.select("id", F.col("path").alias("old_path"), F.col("hash").alias("old_hash"))
    new = sent.select("id", F.col("path").alias("new_path"), F.col("hash").alias("new_hash"))
    both = old.join(new, "id", "full_outer")
    touched = removed.select("path").unionByName(sent.select("path")).distinct().select(F.col("path").alias("old_path"), F.lit(True).alias("touched"))
    both = both.join(touched, "old_path", "left")
    action = F.when(F.col("new_hash").isNotNull() & (F.col("old_hash") == F.col("new_hash")), "skipped").when(F.col("new_hash").isNotNull(), "added").when(F.col("touched"), "removed").otherwise("kept")
    return both.select("id", action.alias("action"))


def index_counts(plan: DataFrame) -> DataFrame:
    """added, skipped, removed, total."""
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(n("added").alias("added"), n("skipped").alias("skipped"), n("removed").alias("removed"), F.count_if(F.col("action") != "removed").alias("total"))


def upsert_index(stored: DataFrame, sent: DataFrame, plan: DataFrame) -> DataFrame:
    """The chunks after the plan: sent ones replace those with their ids."""
    fresh = sent.join(plan.where("action = 'added'").select("id"), "id", "left_semi")
    kept = stored.join(plan.where("action in ('kept', 'skipped')").select("id"), "id", "left_semi")
    return kept.select(*stored.columns).unionByName(fresh.select(*stored.columns))
