"""From a question to the entities that it is about, what stands around them, and facts to ground an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.search import neighbour_labels
from graphloom.schema import TYPE_KINDS

# fixed values: what identifiers and routes look like in a question
IDENTIFIER = r"[A-Za-z_$][\w$]*(?:[.#][A-Za-z_$][\w$]*)?"
ROUTE = r"/[\w{}/.-]+"
MAX_ENTITIES, METHODS, CALLERS = 4, 6, 4


def mentions(questions: DataFrame, entity: DataFrame, most: int = MAX_ENTITIES) -> DataFrame:
    """query_id, id, place of the entities that each question (query_id, text) names, in its order, at most so many.

    `Type#member` and `Type.member` name members, or else the type; other identifiers name types; routes name endpoints,
    two each at most, after all identifiers.
    """
    types = entity.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("id").alias("type_id"), F.col("name").alias("owner"))
    token = questions.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("at", "token"))
    token = token.select("query_id", "at", F.regexp_extract("token", r"^([^.#]*)", 1).alias("owner"), F.regexp_extract("token", r"[.#](.*)$", 1).alias("member"))
    hit = token.join(types, "owner")
    children = entity.where("parent_id is not null").select(F.col("parent_id").alias("type_id"), F.col("name").alias("member"), "id")
    members = hit.where("member <> ''").join(children, ["type_id", "member"]).select("query_id", "at", "id")
    plain = hit.join(members.select("query_id", "at").distinct(), ["query_id", "at"], "left_anti").select("query_id", "at", F.col("type_id").alias("id"))
    route = questions.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(ROUTE), F.lit(0))).alias("at", "route"))
    # a route is somewhere in an endpoint's name: every string in it that begins with a slash is a key
    size, sub = F.length("name"), lambda i, n: F.substring(F.col("name"), i, n)
    slashes = F.filter(F.sequence(F.lit(1), size), lambda i: (sub(i, F.lit(1)) == "/") & (i < size))
    held = F.flatten(F.transform(slashes, lambda i: F.transform(F.sequence(i + 1, size), lambda j: sub(i, j - i + 1))))
    ends = entity.where("kind = 'ENDPOINT' and length(name) > 1").select("id", F.explode(F.array_distinct(held)).alias("route"))
    ends = route.join(ends, "route")
    ends = ends.withColumn("n_", F.row_number().over(Window.partitionBy("query_id", "at").orderBy("id"))).where("n_ <= 2").select("query_id", (F.col("at") + 1_000_000).alias("at"), "id")
    every = members.unionByName(plain).unionByName(ends).groupBy("query_id", "id").agg(F.min("at").alias("at"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))).where(F.col("place") <= most).select("query_id", "id", "place")


def focus(mentioned: DataFrame, entity: DataFrame, edge: DataFrame, methods: int = METHODS, callers: int = CALLERS) -> DataFrame:
    """query_id, id: what is mentioned, its first methods and its first callers that are no endpoints."""
    asked = mentioned.select("query_id", F.col("id").alias("of"))
    first = lambda rows, n: rows.withColumn("n_", F.row_number().over(Window.partitionBy("query_id", "of").orderBy("id"))).where(F.col("n_") <= n).select("query_id", "id")
    inside = asked.join(entity.where("kind = 'METHOD'").select(F.col("parent_id").alias("of"), "id"), "of")
    calling = edge.select(F.col("dst").alias("of"), F.col("src").alias("id")).distinct().join(entity.where("kind = 'ENDPOINT'").select("id"), "id", "left_anti")
    return mentioned.select("query_id", "id").unionByName(first(inside, methods)).unionByName(first(asked.join(calling, "of"), callers)).distinct()


def facts(entity: DataFrame, measured: DataFrame, edge: DataFrame, labels: int = 12) -> DataFrame:
    """id, facts: what is known of an entity as JSON: name, kind, role, module, metrics and what it depends on."""
    rows = entity.join(measured, "id").join(neighbour_labels(entity, edge, labels).withColumnRenamed("labels", "dependencies_of"), "id", "left")
    numbers = F.struct("fan_in", "fan_out", "dependents", "dependencies", "depth", "risk")
    return rows.select("id", F.to_json(F.struct("qualified_name", entity["kind"].alias("kind"), F.col("stereotype").alias("role"), "module", numbers.alias("metrics"), F.col("dependencies_of").alias("depends_on"))).alias("facts"))


def digest(summary: DataFrame, by_role: DataFrame) -> DataFrame:
    """One row, facts: an impact summary and its roles as JSON."""
    roles = by_role.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "owners")))).alias("roles"))
    return summary.join(roles, how="cross").select(F.to_json(F.struct("direct", "total", "max_depth", "endpoints", "modules", "tests", "risk", "level", "roles")).alias("facts"))  # rows of one
