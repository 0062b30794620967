"""What a change reaches: seeds, affected entities, aggregates, risk and paths that explain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, metrics
from graphloom.schema import TYPE_KINDS
from graphloom.tables import written

MAX_DEPTH, MAX_RESULTS = 10, 500


def seeds_of_entity(entity: DataFrame, ids: DataFrame) -> DataFrame:
    """The entities and all that they contain, however deep."""
    found = step = ids.select("id").distinct()
    inside = entity.where("parent_id is not null").select("parent_id", "id")
    while True:
        step = written(entity.sparkSession, inside.join(step.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id"))
        if step.isEmpty():
            return found.distinct()
        found = found.unionByName(step)


def targets_of_files(entity: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, target (the first type of a file that is in no other, by id), complexity (of all its types), seeds: of files
    that have such a type."""
    mine = entity.join(files.select("file_id").distinct(), "file_id", "left_semi")
    is_type = F.col("kind").isin(*TYPE_KINDS)
    out = mine.groupBy("file_id").agg(F.min(F.when(is_type & F.col("parent_id").isNull(), F.col("id"))).alias("target"), F.coalesce(F.sum(F.when(is_type, F.col("complexity"))), F.lit(0)).cast("long").alias("complexity"), F.count("*").alias("seeds"))
    return out.where("target is not null")


def seeds_of_files(entity: DataFrame, files: DataFrame) -> DataFrame:
    return entity.join(files.select("file_id").distinct(), "file_id", "left_semi").select("id").distinct()


def affected(spark: SparkSession, entity: DataFrame, edge: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, tests: bool = False) -> DataFrame:
    """id, kind, module, package_name, owner_id, role (of the owner), depth, test: all that depends on the seeds.

    Seeds, and what only stands in for an overrider, are not affected. Rows of tests are left out unless asked for.
    """
    max_depth = min(max(max_depth, 1), 30)
    found = graph.bfs(spark, edge, seeds, graph.UPSTREAM, max_depth, True).where(~F.col("dispatched") & (F.col("depth") > 0)).select(F.col("node").alias("id"), "depth")
    found = found.join(seeds.select("id"), "id", "left_anti")
    role = entity.select(F.col("id").alias("owner_id"), F.col("stereotype").alias("owner_role"))
    own = graph.owners(entity).join(role, "owner_id", "left")
    out = found.join(entity.select("id", "kind", "module", "package_name", "stereotype"), "id").join(own, "id")
    out = out.withColumn("role", F.when(F.col("owner_id").isNotNull(), F.col("owner_role")).otherwise(F.col("stereotype"))).withColumn("test", F.coalesce(F.col("owner_role") == "TEST", F.lit(False)))
    out = out.select("id", "kind", "module", "package_name", "owner_id", "role", "depth", "test")
    return out if tests else out.where("not test")


def explanations(spark: SparkSession, entity: DataFrame, edge: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, tests: bool = False) -> DataFrame:
    """id, depth, type (of the last edge), path: for each affected entity the steps by which a change of the seeds gets there."""
    max_depth = min(max(max_depth, 1), 30)
    tree = graph.hops(spark, edge, seeds, graph.UPSTREAM, max_depth, True)
    rows = tree.where("not flag and depth > 0").select(F.col("node").alias("id"), "depth", "type")
    if not tests:
        test = graph.owners(entity).join(entity.where("stereotype = 'TEST'").select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
        rows = rows.join(test.select("id"), "id", "left_anti")
    return rows.join(graph.explained(spark, tree, rows), "id")


def by_role(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """role (OTHER without one), owners: how many types hold affected entities, seeds themselves left out."""
    return rows.where("owner_id is not null").join(seeds.select(F.col("id").alias("owner_id")), "owner_id", "left_anti").groupBy(F.coalesce("role", F.lit("OTHER")).alias("role")).agg(F.count_distinct("owner_id").alias("owners"))


def outside_coupling(edge: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row, coupling: distinct neighbours outside the seeds, whichever way."""
    s = seeds.select("id")
    out = edge.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    into = edge.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return out.unionByName(into).join(s, "id", "left_anti").agg(F.count_distinct("id").alias("coupling"))


def summary(spark: SparkSession, entity: DataFrame, edge: DataFrame, seeds: DataFrame, top: DataFrame, targets: DataFrame, max_depth: int = MAX_DEPTH, max_results: int = MAX_RESULTS) -> DataFrame:
    """One row, of a change to the targets (id; their complexity counts) that touches the seeds: direct, total, max_depth, endpoints, modules, packages, tests, coupling, complexity, exposed, risk, level, truncated."""
    edge = written(spark, edge)
    rows = written(spark, affected(spark, entity, edge, seeds, max_depth, tests=True))
    real = rows.where("not test")
    facts = real.agg(
        F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("total"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("deepest"), F.count_if(F.col("kind") == "ENDPOINT").alias("endpoints"),
        F.array_join(F.array_sort(F.collect_set("module")), ",").alias("modules"), F.count_distinct(F.nullif("package_name", F.lit(""))).alias("packages"),
    )
    tests = rows.where("test").agg(F.count_distinct("owner_id").alias("tests"))
    role = entity.select(F.col("id").alias("owner_id"), F.col("stereotype").alias("owner_role"))
    seed = entity.join(seeds.select("id"), "id", "left_semi").join(graph.owners(entity), "id").join(role, "owner_id", "left")
    api = seed.agg(F.coalesce(F.bool_or((F.col("kind") == "ENDPOINT") | F.coalesce(F.col("owner_role") == "CONTROLLER", F.lit(False))), F.lit(False)).alias("api"))
    own = entity.join(targets.select("id"), "id", "left_semi").agg(F.coalesce(F.sum("complexity"), F.lit(0)).cast("long").alias("complexity")).join(api, how="cross")  # rows of one
    one = facts.join(tests, how="cross").join(outside_coupling(edge, seeds), how="cross").join(own, how="cross")  # rows of one
    one = one.select("*", (F.col("api") | (F.col("endpoints") > 0)).alias("exposed"))
    shaped = one.withColumns({"dependents": F.col("total"), "depth": F.col("deepest"), "fan_in": F.col("coupling"), "fan_out": F.lit(0).cast("long")})
    out = metrics.scored(shaped, top).withColumn("truncated", F.col("total") > max_results)
    return out.select("direct", "total", F.col("depth").alias("max_depth"), "endpoints", "modules", "packages", "tests", "coupling", "complexity", "exposed", "risk", "level", "truncated")


def first_rows(rows: DataFrame, entity: DataFrame, max_results: int = MAX_RESULTS) -> DataFrame:
    """The nearest affected entities, by depth, then name and id."""
    return rows.join(entity.select("id", "name"), "id").orderBy("depth", "name", "id").limit(max_results)


def type_of(entity: DataFrame) -> DataFrame:
    return entity.where(F.col("kind").isin(*TYPE_KINDS))
