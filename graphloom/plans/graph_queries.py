"""Graphs of parts: edges, degrees, traversals, components, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.plans.registry import registry
from graphloom.sources import adapters

QUERIES, ORACLES, query = registry()
WITH = f"WITH RECURSIVE {adapters.SQL}"
SEED, SEED_SQL, LIMIT = "id % 50 = 3", "id % 50 = 3", 10
#: Steps upstream with dispatch, of a relation g.
MOVES_SQL = """mv AS (SELECT dst AS frm, src AS t, 1 AS cost, false AS flag, bool_and(type = 'OVERRIDES') AS closed FROM g GROUP BY dst, src
    UNION ALL SELECT DISTINCT src, dst, 0, true, false FROM g WHERE type = 'OVERRIDES')"""
CLOSURE_SQL = f"""{MOVES_SQL},
up AS (SELECT id AS start, id AS node, false AS flag FROM entity UNION SELECT u.start, m.t, m.flag FROM up u JOIN mv m ON m.frm = u.node WHERE NOT (u.flag AND m.closed)),
down AS (SELECT id AS start, id AS node FROM entity UNION SELECT d.start, g.dst FROM down d JOIN g ON g.src = d.node),
ups AS (SELECT start AS id, count(DISTINCT node) - 1 AS dependents FROM up GROUP BY start),
ends AS (SELECT u.start AS id, bool_or(e.kind = 'ENDPOINT') AS reaches_endpoint FROM up u JOIN entity e ON u.node = e.id WHERE NOT u.flag AND u.node <> u.start GROUP BY u.start),
downs AS (SELECT start AS id, count(*) - 1 AS dependencies FROM down GROUP BY start),
closure AS (SELECT u.id, u.dependents::BIGINT AS dependents, d.dependencies::BIGINT AS dependencies, coalesce(n.reaches_endpoint, false) AS reaches_endpoint FROM ups u JOIN downs d USING (id) LEFT JOIN ends n USING (id)),
mutual AS (SELECT a.start AS id, min(a.node) AS component FROM down a JOIN down b ON a.start = b.node AND a.node = b.start GROUP BY a.start),
clinks AS (SELECT DISTINCT x.component AS a, y.component AS b FROM g JOIN mutual x ON g.src = x.id JOIN mutual y ON g.dst = y.id WHERE x.component <> y.component),
chain AS (SELECT DISTINCT component, 0 AS d FROM mutual UNION SELECT l.a, c.d + 1 FROM chain c JOIN clinks l ON l.b = c.component),
depth AS (SELECT m.id, m.component, max(c.d)::INT AS depth FROM mutual m JOIN chain c USING (component) GROUP BY ALL)"""


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return adapters.entities(spark, sf_dir), adapters.edges(spark, sf_dir)


@query(f"{WITH} SELECT src, dst, type, weight FROM edge WHERE src IN (SELECT id FROM entity) AND dst IN (SELECT id FROM entity)")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(*both(spark, sf_dir))


@query(f"""{WITH}, p AS (SELECT DISTINCT src, dst FROM edge)
SELECT e.id, coalesce(i.n, 0)::BIGINT AS fan_in, coalesce(o.n, 0)::BIGINT AS fan_out FROM entity e LEFT JOIN (SELECT dst, count(*) n FROM p GROUP BY 1) i ON i.dst = e.id LEFT JOIN (SELECT src, count(*) n FROM p GROUP BY 1) o ON o.src = e.id""")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(*both(spark, sf_dir))


@query(f"{WITH}, {adapters.ROLLUP_SQL} SELECT * FROM rolled")
def graph_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roll_up(*both(spark, sf_dir))


@query(f"""{WITH} SELECT src, dst, type, sum(w)::BIGINT AS weight FROM (SELECT src, dst, type, count(*) AS w FROM raw_edge WHERE ord % 2 = 0 GROUP BY ALL
UNION ALL SELECT src, dst, type, 1 FROM raw_edge WHERE ord % 2 = 1) GROUP BY ALL""")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.incremental import upsert_edges

    raw = adapters.raw_edges(spark, sf_dir)
    return upsert_edges(graph.merge_edges(raw.where("`order` % 2 = 0")), raw.where("`order` % 2 = 1"))


@query(f"""{WITH}, r AS (SELECT id AS node, 0 AS d FROM entity WHERE {SEED_SQL} UNION SELECT e.dst, r.d + 1 FROM r JOIN edge e ON e.src = r.node WHERE r.d < {LIMIT})
SELECT node, min(d)::INT AS depth FROM r GROUP BY node""")
def bfs_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    return graph.bfs(spark, edge, entity.where(SEED), graph.DOWNSTREAM, LIMIT).select("node", "depth")


@query(f"""{WITH}, g AS (SELECT * FROM edge), {MOVES_SQL}, r AS (SELECT id AS node, false AS flag, 0 AS d FROM entity WHERE {SEED_SQL}
UNION SELECT m.t, m.flag, r.d + m.cost FROM r JOIN mv m ON m.frm = r.node WHERE NOT (r.flag AND m.closed) AND r.d + m.cost <= {LIMIT})
SELECT node, min(d)::INT AS depth, bool_and(flag) AS dispatched FROM r GROUP BY node""")
def bfs_upstream_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    return graph.bfs(spark, edge, entity.where(SEED), graph.UPSTREAM, LIMIT, True)


@query(f"""{WITH}, r AS (SELECT id AS source, id AS node, 0 AS d FROM entity WHERE id < 400 UNION SELECT r.source, e.dst, r.d + 1 FROM r JOIN edge e ON e.src = r.node WHERE r.d < 30)
SELECT source, node AS target, min(d)::INT AS length FROM r WHERE node < 400 AND node <> source GROUP BY ALL""")
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    found = graph.reach(spark, graph.moves(edge), entity.where("id < 400"), 30)
    return found.where("node < 400 and node <> start").select(F.col("start").alias("source"), F.col("node").alias("target"), F.col("depth").alias("length"))


@query(f"""{WITH}, l AS (SELECT DISTINCT src, dst FROM edge), r AS (SELECT id AS source, id AS node, [id] AS path FROM entity WHERE id % 10 = 1 AND id < 1000000000
UNION ALL SELECT r.source, l.dst, list_append(r.path, l.dst) FROM r JOIN l ON l.src = r.node WHERE len(r.path) <= 6 AND NOT list_contains(r.path, l.dst)),
p AS (SELECT source, node AS target, path, row_number() OVER (PARTITION BY source, node ORDER BY len(path), path) AS n FROM r WHERE len(path) > 1 AND node % 10 = 2)
SELECT source, target, array_to_string(path, '>') AS path FROM p WHERE n <= 20""")
def all_paths_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    found = graph.all_paths(spark, edge, entity.where("id % 10 = 1 and parent_id is not null"), entity.where("id % 10 = 2 and parent_id is not null"), 6, 20)
    return found.select("source", "target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""{WITH}, l AS (SELECT DISTINCT src, dst FROM edge),
u AS (SELECT id AS node, 0 AS d FROM entity WHERE {SEED_SQL} UNION SELECT l.src, u.d + 1 FROM u JOIN l ON l.dst = u.node WHERE u.d < 2),
w AS (SELECT id AS node, 0 AS d FROM entity WHERE {SEED_SQL} UNION SELECT l.dst, w.d + 1 FROM w JOIN l ON l.src = w.node WHERE w.d < 2),
near AS (SELECT node AS id, min(d) AS distance FROM (SELECT * FROM u UNION ALL SELECT * FROM w) GROUP BY 1),
v AS (SELECT n.id, n.distance::INT AS distance, e.complexity::DOUBLE AS risk FROM near n JOIN entity e USING (id) LEFT JOIN entity o ON o.id = coalesce(e.parent_id, e.id)
  WHERE coalesce(o.stereotype, '') <> 'TEST' OR n.distance = 0)
SELECT *, (SELECT count(*) FROM v) > 60 AS truncated FROM v ORDER BY greatest(distance, 0), risk DESC, id LIMIT 60""")
def neighborhood_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    risk = entity.select("id", F.col("complexity").cast("double").alias("risk"))
    return graph.neighbourhood(spark, entity, edge, risk, entity.where(SEED), 2, 60)


@query(f"{WITH}, g AS (SELECT * FROM edge), {CLOSURE_SQL} SELECT * FROM closure")
def closure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure_counts(spark, *both(spark, sf_dir))


@query(f"{WITH}, g AS (SELECT * FROM edge), {CLOSURE_SQL} SELECT id, component FROM mutual")
def scc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(spark, *both(spark, sf_dir))


@query(f"{WITH}, g AS (SELECT * FROM edge), {CLOSURE_SQL} SELECT component, count(*) AS size, array_to_string(list_sort(list(id)), ',') AS members FROM mutual GROUP BY 1 HAVING count(*) > 1")
def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.cycles(spark, *both(spark, sf_dir))
    return found.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(f"{WITH}, g AS (SELECT * FROM edge), {CLOSURE_SQL} SELECT * FROM depth")
def condensation_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(spark, *both(spark, sf_dir))


@query(f"{WITH} SELECT id, coalesce(parent_id, id) AS owner_id FROM entity")
def owner_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.owners(adapters.entities(spark, sf_dir))


@query(f"{WITH} SELECT parent_id AS id, count(*) AS members FROM entity WHERE parent_id IS NOT NULL GROUP BY 1")
def members_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.entities(spark, sf_dir).where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("members"))


@query(f"{WITH} SELECT e.id, o.stereotype AS role, coalesce(o.stereotype = 'TEST', false) AS test FROM entity e LEFT JOIN entity o ON o.id = coalesce(e.parent_id, e.id)")
def effective_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = adapters.entities(spark, sf_dir)
    own = graph.owners(entity).join(entity.select(F.col("id").alias("owner_id"), F.col("stereotype").alias("owner_role")), "owner_id", "left")
    out = entity.select("id", "stereotype").join(own, "id")
    return out.select("id", F.when(F.col("owner_id").isNotNull(), F.col("owner_role")).otherwise(F.col("stereotype")).alias("role"), F.coalesce(F.col("owner_role") == "TEST", F.lit(False)).alias("test"))


@query(f"""{WITH}, keep AS (SELECT id FROM entity WHERE complexity >= 20) SELECT src, dst, type, weight FROM edge WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)""")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    return graph.induced(edge, entity.where("complexity >= 20"))


@query(f"""{WITH}, {adapters.ROLLUP_SQL} SELECT src, dst, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, sum(weight)::BIGINT AS weight,
CASE WHEN bool_or(type = 'OVERRIDES') THEN 'OVERRIDES' WHEN bool_or(type = 'CALLS') THEN 'CALLS' ELSE 'USES_TYPE' END AS main_type FROM rolled GROUP BY src, dst""")
def merged_edges_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merged_view(graph.roll_up(*both(spark, sf_dir)))
