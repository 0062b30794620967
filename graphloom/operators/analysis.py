"""Analysis runs of a project: in full, or of what has changed since the tables that are stored.

Parsed files are kept with their hashes, so a file is read again only when its text changes. An incremental run parses what
is new, resolves the files whose results can differ (new and changed ones, those with edges into changed or deleted files,
those with names that a new type may now answer), and patches the stored tables; the tables equal those of a full run.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import incremental, resolve
from graphloom.sources import java
from graphloom.tables import written


class Project(NamedTuple):
    """files (path, module, sha256), facts (rows of `java.facts` and sha256), entity, edge."""

    files: DataFrame
    facts: DataFrame
    entity: DataFrame
    edge: DataFrame


def parsed(spark: SparkSession, files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Facts of files (path, sha256, text), and sha256: those that the cache holds for the same text are not read again."""
    hashes = files.select("path", "sha256")
    if cache is None:
        return written(spark, java.facts(files).join(hashes, "path"))
    known = cache.select("path", "sha256").distinct()
    fresh = java.facts(files.join(known, ["path", "sha256"], "left_anti")).join(hashes, "path")
    return written(spark, cache.join(hashes, ["path", "sha256"], "left_semi").unionByName(fresh))


def full(spark: SparkSession, files: DataFrame) -> Project:
    """All tables of files (path, module, sha256, text)."""
    facts = parsed(spark, files)
    names = resolve.Names(spark, facts)
    entity = written(spark, resolve.entities(names).join(files.select("path", "module"), "path", "left"))
    return Project(written(spark, files.select("path", "module", "sha256")), facts, entity, resolve.linked(spark, entity, resolve.edges(names)))


def affected(stored: Project, facts: DataFrame, changes: DataFrame) -> DataFrame:
    """path, why (fresh, dependent, waiting) of the files to resolve again. changes: path, change; facts: of the new texts."""
    fresh = changes.where("change <> 'deleted'").select("path")
    ids = lambda df: df.select(F.xxhash64("path").alias("file_id"))
    lost = ids(changes.where("change <> 'added'"))
    paths = stored.files.select("path", F.xxhash64("path").alias("file_id"))
    dependent = incremental.dependents(stored.entity, stored.edge, lost).join(paths, "file_id").select("path")
    types = lambda df: df.where("what = 'type'").select("name").distinct()
    added = types(facts.join(fresh, "path", "left_semi")).join(types(stored.facts.join(changes.where("change = 'deleted'").select("path"), "path", "left_anti").join(fresh, "path", "left_anti")), "name", "left_anti")
    words = F.concat_ws(" ", "name", "type_text", "scope", F.array_join("supers", " "), F.array_join("annotations", " "))
    used = facts.select("path", F.explode(F.regexp_extract_all(words, F.lit(fn.WORD), F.lit(0))).alias("name")).distinct()
    waiting = incremental.waiting(used.select(F.col("path").alias("file_id"), "name"), added, fresh.select(F.col("path").alias("file_id"))).select(F.col("file_id").alias("path"))
    every = fresh.withColumn("rank", F.lit(0)).unionByName(dependent.withColumn("rank", F.lit(1))).unionByName(waiting.withColumn("rank", F.lit(2)))
    every = every.join(changes.where("change = 'deleted'").select("path"), "path", "left_anti").groupBy("path").agg(F.min("rank").alias("rank"))
    return every.select("path", F.element_at(F.array(F.lit("fresh"), F.lit("dependent"), F.lit("waiting")), F.col("rank") + 1).alias("why"))


def incremental_run(spark: SparkSession, stored: Project, files: DataFrame) -> tuple[Project, dict[str, int]]:
    """The project after an edit, and counts: added, changed, deleted, dependent, waiting."""
    changes = written(spark, incremental.change_set(stored.files, files))
    counts = dict.fromkeys(("added", "changed", "deleted", "dependent", "waiting"), 0)
    counts |= {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}  # at most three rows
    if not sum(counts.values()):
        return stored, counts
    facts = parsed(spark, files, stored.facts)
    again = written(spark, affected(stored, facts, changes))
    counts |= {r["why"]: r["count"] for r in again.where("why <> 'fresh'").groupBy("why").count().collect()}  # at most two rows
    names = resolve.Names(spark, facts)
    ids = lambda df: df.select(F.xxhash64("path").alias("file_id"))
    fresh = resolve.entities(names).join(again.where("why = 'fresh'").select("path"), "path", "left_semi").join(files.select("path", "module"), "path", "left")
    entity = written(spark, incremental.patch_entities(stored.entity, fresh.drop("id"), ids(changes)))
    found = resolve.linked(spark, entity, resolve.edges(names, again))
    gone = ids(again.select("path").unionByName(changes.select("path")))
    edge = written(spark, incremental.patch_edges(stored.edge, found, gone, entity))
    return Project(written(spark, files.select("path", "module", "sha256")), facts, entity, edge), counts
