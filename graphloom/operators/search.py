"""Look-ups: ranked substring search, details, relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as fn
from graphloom.operators.graph import owners


def ranked(entity: DataFrame, query: str | None, kinds: tuple[str, ...] = (), n: int = 20) -> DataFrame:
    """Entities whose name or qualified name holds the query, whatever the case: equal names first, then those that begin so."""
    q = (query or "").strip().lower()
    if not q:
        return entity.limit(0)
    name = F.lower("name")
    found = entity.where(F.contains(name, F.lit(q)) | F.contains(F.lower("qualified_name"), F.lit(q)))
    found = found.where(F.col("kind").isin(*kinds)) if kinds else found
    rank = F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1).otherwise(2)
    return found.withColumn("rank", rank).orderBy("rank", F.length("name"), "name", "id").limit(min(max(n, 1), 100))


def relations(entity: DataFrame, edge: DataFrame, n: int = 200) -> DataFrame:
    """id, way, type, other, place: the first n relations of each entity each way, by type, name and id."""
    names = entity.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    out = edge.select(F.col("src").alias("id"), F.lit("out").alias("way"), "type", F.col("dst").alias("other"))
    into = edge.select(F.col("dst").alias("id"), F.lit("in").alias("way"), "type", F.col("src").alias("other"))
    rows = out.unionByName(into).join(names, "other")
    place = F.row_number().over(Window.partitionBy("id", "way").orderBy("type", "other_name", "other"))
    return rows.withColumn("place", place).where(F.col("place") <= min(max(n, 1), 200)).select("id", "way", "type", "other", "place")


def relation_groups(edge: DataFrame, entity_ids: DataFrame) -> DataFrame:
    """type, way, n over the relations of some entities."""
    ids = entity_ids.select("id")
    out = edge.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("type", F.lit("out").alias("way"))
    into = edge.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("type", F.lit("in").alias("way"))
    return out.unionByName(into).groupBy("type", "way").agg(F.count("*").alias("n"))


def neighbour_labels(entity: DataFrame, edge: DataFrame, n: int = 12) -> DataFrame:
    """id, labels: names of what it depends on, sorted, the first n and how many more."""
    names = edge.select("src", "dst").distinct().join(entity.select(F.col("id").alias("dst"), "name"), "dst")
    names = names.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("all"))
    more = F.when(F.size("all") > n, F.concat(F.lit(", … and "), (F.size("all") - n).cast("string"), F.lit(" more"))).otherwise("")
    return names.select("id", F.concat(F.array_join(F.slice("all", 1, n), ", "), more).alias("labels"))


def details(entity: DataFrame, measured: DataFrame, edge: DataFrame) -> DataFrame:
    """id, kind, risk (0 without a metric), parent_name, members, n_out, n_in."""
    parent = entity.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    members = entity.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("members")).where("id is not null")
    out, into = (edge.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(n)) for c, n in (("src", "n_out"), ("dst", "n_in")))
    rows = entity.join(measured.select("id", "risk"), "id", "left").join(parent, "parent_id", "left").join(members, "id", "left").join(out, "id", "left").join(into, "id", "left")
    return rows.select("id", "kind", F.coalesce("risk", F.lit(0.0)).alias("risk"), "parent_name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("members", "n_out", "n_in")))


def summaries(entity: DataFrame, measured: DataFrame, asked: DataFrame) -> DataFrame:
    """place, id, name, label, kind, role (its own, or its owner's), risk (null without a metric) of the entities asked for
    (place, id), in whatever order they were asked; unknown ids drop out."""
    own = owners(entity).join(entity.select(F.col("id").alias("owner_id"), F.col("stereotype").alias("owner_role")), "owner_id", "left")
    rows = asked.select("place", "id").join(entity.select("id", "name", "qualified_name", "kind", "stereotype"), "id").join(own, "id").join(measured.select("id", "risk"), "id", "left")
    role = F.when(F.col("owner_id").isNotNull(), F.col("owner_role")).otherwise(F.col("stereotype"))
    return rows.select("place", "id", "name", fn.label("qualified_name", "kind", "name").alias("label"), "kind", role.alias("role"), "risk")


def by_name(entity: DataFrame, asked: DataFrame) -> DataFrame:
    """Entities by qualified name (asked: qualified_name)."""
    return entity.join(asked.select("qualified_name").distinct(), "qualified_name", "left_semi")


def children(entity: DataFrame, asked: DataFrame) -> DataFrame:
    """parent_id, place, id, name: the direct members of the entities asked for (id), by line, then id."""
    mine = entity.join(asked.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    return mine.select("parent_id", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.col("start_line").asc_nulls_last(), "id")).alias("place"), "id", "name")


def linked(hits: DataFrame, entity: DataFrame) -> DataFrame:
    """hits with entity_id: the entity of a hit's qualified name, null where there is none (any more)."""
    return hits.join(entity.select("qualified_name", F.col("id").alias("entity_id")), "qualified_name", "left")


def focused(entity: DataFrame, shown: DataFrame, asked: DataFrame) -> DataFrame:
    """id, focus: where a view of the entities shown (id) centres for each one asked for: itself, or else the type that it
    belongs to; those with neither drop out."""
    there = shown.select(F.col("id").alias("focus")).distinct()
    own = asked.select("id").distinct().join(owners(entity), "id")
    itself = own.join(there, F.col("id") == F.col("focus")).select("id", "focus")
    above = own.join(itself, "id", "left_anti").join(there, F.col("owner_id") == F.col("focus")).select("id", "focus")
    return itself.unionByName(above)


def nodes(entity: DataFrame, files: DataFrame) -> DataFrame:
    """Entities with the path and module of their file (file_id, path, module), in the place of their own module where they have
    one; those whose file is unknown (endpoints of no file) stay, without a path."""
    known = files.select("file_id", "path", F.col("module").alias("file_module"))
    return entity.join(known, "file_id", "left").withColumn("module", F.coalesce("file_module", "module")).drop("file_module")


def owned(rows: DataFrame, projects: DataFrame, owners: DataFrame, by: str = "project_id") -> DataFrame:
    """rows of the projects (by, owner) of these owners (owner), with their owner; those of others, and of nobody, are left out."""
    return rows.join(projects.join(owners.select("owner").distinct(), "owner", "left_semi").select(by, "owner"), by)
