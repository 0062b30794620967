"""Risk scores, package coupling and complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.schema import METHOD_KINDS, TYPE_KINDS
from graphloom.tables import ratio, rounded, written

# fixed values: weights of the risk score's factors, in the order of its sum
WEIGHTS = (("dependents", 0.30), ("depth", 0.15), ("coupling", 0.20), ("complexity", 0.20), ("exposed", 0.15))
HIGH, MEDIUM = 60.0, 30.0
# fixed values: least complexity of each bucket
BUCKETS = ((20, "20+"), (10, "10-19"), (5, "5-9"), (2, "2-4"))


def normalised(value: Column, top: Column) -> Column:
    """Logarithmic share of the greatest value, to 3 places; 0 where either isn't positive."""
    return F.when((value <= 0) | (top <= 0), F.lit(0.0)).otherwise(rounded(F.least(F.lit(1.0), F.log1p(value.cast("double")) / F.log1p(top.cast("double")))))


def scale(metrics: DataFrame) -> DataFrame:
    """One row: the greatest dependents, depth, coupling and complexity of all entities."""
    top = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long")
    return metrics.agg(top("dependents").alias("max_dependents"), top("depth").alias("max_depth"), top(F.col("fan_in") + F.col("fan_out")).alias("max_coupling"), top("complexity").alias("max_complexity"))


def level(risk: Column) -> Column:
    return F.when(risk >= HIGH, "HIGH").when(risk >= MEDIUM, "MEDIUM").otherwise("LOW")


def scored(metrics: DataFrame, top: DataFrame) -> DataFrame:
    """metrics with a normalised column f_<factor> each, risk and level; top is one row."""
    out = metrics.join(F.broadcast(top), how="cross")  # one row
    out = out.withColumns({
        "f_dependents": normalised(F.col("dependents"), F.col("max_dependents")),
        "f_depth": normalised(F.col("depth"), F.col("max_depth")),
        "f_coupling": normalised(F.col("fan_in") + F.col("fan_out"), F.col("max_coupling")),
        "f_complexity": normalised(F.col("complexity"), F.col("max_complexity")),
        "f_exposed": F.when(F.col("exposed"), F.lit(1.0)).otherwise(F.lit(0.0)),
    })
    raw = F.lit(0.0)
    for i, (name, w) in enumerate(WEIGHTS):
        raw = F.col(f"f_{name}") * F.lit(w) if i == 0 else raw + F.col(f"f_{name}") * F.lit(w)
    risk = F.floor(F.least(F.lit(1.0), raw) * F.lit(1000.0) + F.lit(0.5)).cast("double") / F.lit(10.0)
    return out.withColumn("risk", risk).withColumn("level", level(F.col("risk"))).drop("max_dependents", "max_depth", "max_coupling", "max_complexity")


def contributions(risks: DataFrame) -> DataFrame:
    """id, factor, points: what each factor adds to the score."""
    parts = F.array(*(F.struct(F.lit(n).alias("factor"), (F.col(f"f_{n}") * F.lit(w) * F.lit(100.0)).alias("points")) for n, w in WEIGHTS))
    return risks.select("id", F.explode(parts).alias("part")).select("id", "part.factor", rounded(F.col("part.points")).alias("points"))


def measured(spark: SparkSession, entity: DataFrame, edge: DataFrame) -> DataFrame:
    """id, kind, fan_in, fan_out, dependents, dependencies, depth, complexity, exposed.

    Members are measured on the graph as it is, types on the graph of types. A member is exposed if an endpoint depends
    on it or it is one, a type if a member is or it is a controller.
    """
    edge = written(spark, edge)  # read for both graphs
    is_type = F.col("kind").isin(*TYPE_KINDS)
    members, types = entity.where(~is_type), entity.where(is_type)
    parts = []
    for nodes, links in ((members, edge), (types, graph.roll_up(entity, edge))):
        links = written(spark, graph.build(nodes, links))
        closed = written(spark, graph.closure(spark, nodes, links))
        part = graph.degree(nodes, links).join(closed.drop("component"), "id").join(graph.depths(spark, nodes, links, closed.select("id", "component")).select("id", "depth"), "id")
        parts.append(nodes.select("id", "kind", "parent_id", "stereotype", F.col("complexity").cast("long").alias("complexity")).join(part, "id"))
    member = parts[0].withColumn("exposed", F.col("reaches_endpoint") | (F.col("kind") == "ENDPOINT"))
    member = written(spark, member)
    inside = member.groupBy(F.col("parent_id").alias("id")).agg(F.bool_or("exposed").alias("inside"))
    whole = parts[1].join(inside, "id", "left").withColumn("exposed", F.coalesce("inside", F.lit(False)) | F.coalesce(F.col("stereotype") == "CONTROLLER", F.lit(False))).drop("inside")
    keep = ["id", "kind", "fan_in", "fan_out", "dependents", "dependencies", "depth", "complexity", "exposed"]
    return written(spark, member.select(*keep).unionByName(whole.select(*keep)))


def coupling(entity: DataFrame, edge: DataFrame, by: str) -> DataFrame:
    """Per group (package_name or module): types, ca, ce, instability, abstractness, distance. Tests count nowhere."""
    key = F.when(F.coalesce(by, F.lit("")) == "", "(default)").otherwise(F.col(by))
    types = entity.where(F.col("kind").isin(*TYPE_KINDS) & (F.coalesce("stereotype", F.lit("")) != "TEST")).select("id", key.alias("grp"), "is_abstract")
    links = graph.roll_up(entity, edge).select("src", "dst").distinct()
    links = links.join(types.select(F.col("id").alias("src"), F.col("grp").alias("a")), "src").join(types.select(F.col("id").alias("dst"), F.col("grp").alias("b")), "dst").where("a <> b")
    ce = links.groupBy(F.col("a").alias("grp")).agg(F.count_distinct("dst").alias("ce"))
    ca = links.groupBy(F.col("b").alias("grp")).agg(F.count_distinct("src").alias("ca"))
    out = types.groupBy("grp").agg(F.count("*").alias("types"), F.count_if("is_abstract").alias("abstract_types")).join(ca, "grp", "left").join(ce, "grp", "left").fillna(0, ["ca", "ce"])
    i, a = ratio(F.col("ce"), F.col("ca") + F.col("ce")), ratio(F.col("abstract_types"), F.col("types"))
    return out.select("grp", "types", "ca", "ce", rounded(i).alias("instability"), rounded(a).alias("abstractness"), rounded(F.abs(a + i - 1)).alias("distance"))


def complexity_bucket(value: Column) -> Column:
    out = F.lit("1")
    for least, name in reversed(BUCKETS):
        out = F.when(value >= least, name).otherwise(out)
    return out


def complexity_buckets(entity: DataFrame) -> DataFrame:
    """bucket, n over methods and constructors."""
    return entity.where(F.col("kind").isin(*METHOD_KINDS)).groupBy(complexity_bucket(F.col("complexity")).alias("bucket")).agg(F.count("*").alias("n"))
