"""The graph queries over every two consecutive lines, without the bound on quantities: NAME_whole for each NAME.

The SQL of closures follows all routes: it takes seconds on 30,000 pairs of lines, and much longer on more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, impact, incremental, search
from graphloom.plans import graph_queries, metric_queries, portfolio_queries, retrieval_queries
from graphloom.plans.registry import Query, registry
from graphloom.sources import adapters

QUERIES, ORACLES, query = registry()
ALL = {k: v for part in (graph_queries, metric_queries, portfolio_queries, retrieval_queries) for k, v in part.QUERIES.items()}
SQL = {k: v for part in (graph_queries, metric_queries, portfolio_queries, retrieval_queries) for k, v in part.ORACLES.items()}
BOUND_SQL = f"a.l_quantity >= {adapters.QUANTITY} AND b.l_quantity >= {adapters.QUANTITY} AND "
PLAIN = (
    "graph_edges", "graph_degree", "graph_rollup", "edge_upsert", "induced_edges", "merged_edges_view", "package_coupling", "module_coupling", "merged_coupling_points",
    "kpi_edge_counts", "entity_detail", "incremental_equals_full", "focus_set",
)
CLOSURES = ("closure_counts", "scc_components", "cycle_members", "condensation_depth", "risk_scores", "risk_levels", "project_scale", "factor_contributions", "hotspots_topk", "risk_distribution")


def whole_sql(name: str) -> str:
    """The SQL of a query without the bound on quantities."""
    assert BOUND_SQL in SQL[name]
    return SQL[name].replace(BOUND_SQL, "")


def whole(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with adapters.all_lines():
            return ALL[name](spark, sf_dir)

    run.__name__ = f"{name}_whole"
    return run


for _name in (*PLAIN, *CLOSURES):
    query(whole_sql(_name))(whole(_name))


#: The stated query set: ids divisible by 100. Searches go from these to all targets.
STATED = "id % 100 = 0"


def stated_sql(name: str, *swaps: tuple[str, str]) -> str:
    """The SQL of a query over all lines, for the stated query set or other limits."""
    sql = whole_sql(name)
    for old, new in swaps:
        assert old in sql
        sql = sql.replace(old, new)
    return sql


def all_both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    with adapters.all_lines():
        return graph_queries.both(spark, sf_dir)


SEEDS = (graph_queries.SEED_SQL, STATED)


@query(stated_sql("shortest_path_len", ("WHERE id < 400", f"WHERE {STATED}"), ("node < 400 AND node <> source", "node <> source")))
def shortest_path_len_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = all_both(spark, sf_dir)
    found = graph.reach(spark, graph.moves(edge), entity.where(STATED), 30).where("node <> start")
    return found.select(F.col("start").alias("source"), F.col("node").alias("target"), F.col("depth").alias("length"))


@query(SQL["all_paths_bounded"].replace("id % 10 = 1 AND id < 1000000000", STATED).replace(" AND node % 10 = 2", ""))
def all_paths_bounded_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over lines in large quantities only: the paths among all lines are some 15^6 a start."""
    entity, edge = graph_queries.both(spark, sf_dir)
    found = graph.all_paths(spark, edge, entity.where(STATED), entity, 6, 20)
    return found.select("source", "target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(stated_sql("bfs_downstream", SEEDS))
def bfs_downstream_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = all_both(spark, sf_dir)
    return graph.bfs(spark, edge, entity.where(STATED), graph.DOWNSTREAM, graph_queries.LIMIT).select("node", "depth")


@query(stated_sql("bfs_upstream_dispatch", SEEDS))
def bfs_upstream_dispatch_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = all_both(spark, sf_dir)
    return graph.bfs(spark, edge, entity.where(STATED), graph.UPSTREAM, graph_queries.LIMIT, True)


@query(stated_sql("neighborhood_view", SEEDS, ("> 60 AS", "> 500 AS"), ("LIMIT 60", "LIMIT 500")))
def neighborhood_view_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = all_both(spark, sf_dir)
    risk = entity.select("id", F.col("complexity").cast("double").alias("risk"))
    return graph.neighbourhood(spark, entity, edge, risk, entity.where(STATED), 2)


@query(stated_sql("relations_topn"))
def relations_topn_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.relations(*all_both(spark, sf_dir))


@query(stated_sql("relation_groups"))
def relation_groups_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = all_both(spark, sf_dir)
    return search.relation_groups(edge, entity)


@query(stated_sql("neighbor_labels"))
def neighbor_labels_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.neighbour_labels(*all_both(spark, sf_dir))


@query(stated_sql("dependents_of_changed", ("t.file_id < 5", "t.file_id % 100 = 0"), ("s.file_id >= 5", "s.file_id % 100 <> 0")))
def dependents_of_changed_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = all_both(spark, sf_dir)
    edge = edge.join(entity.select(F.col("id").alias("src"), "file_id"), "src")
    return incremental.dependents(entity, edge, entity.where("file_id % 100 = 0").select("file_id").distinct())


def _stated_impact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    entity, edge = all_both(spark, sf_dir)
    return entity, edge, impact.seeds_of_entity(entity, entity.where(STATED))


@query(stated_sql("impact_affected", SEEDS))
def impact_affected_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.affected(spark, *_stated_impact(spark, sf_dir))


@query(stated_sql("impact_by_role", SEEDS))
def impact_by_role_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge, seeds = _stated_impact(spark, sf_dir)
    return impact.by_role(impact.affected(spark, entity, edge, seeds), seeds)


@query(stated_sql("impact_first_rows", SEEDS, ("LIMIT 50", "LIMIT 500")))
def impact_first_rows_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.first_rows(impact_affected_whole(spark, sf_dir), adapters.entities(spark, sf_dir))


@query(stated_sql("impact_summary", SEEDS))
def impact_summary_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = spark.range(1).selectExpr("100L max_dependents", "10L max_depth", "50L max_coupling", "1000L max_complexity")
    entity, edge, seeds = _stated_impact(spark, sf_dir)
    return impact.summary(spark, entity, edge, seeds, top, entity.where(STATED))


BETWEEN = ("id % 100 = 0", "id % 97 = 5", 4, 20)


@query(f"""{graph_queries.WITH.replace(BOUND_SQL, "")}, l AS (SELECT DISTINCT src, dst FROM edge), t AS (SELECT id FROM entity WHERE {BETWEEN[1]}),
p AS (SELECT id AS source, [id] AS path, id AS here FROM entity WHERE {BETWEEN[0]} UNION ALL SELECT p.source, list_append(p.path, l.dst), l.dst FROM p JOIN l ON l.src = p.here WHERE len(p.path) <= {BETWEEN[2]} AND NOT list_contains(p.path, l.dst))
SELECT source, here AS target, array_to_string(path, '>') AS path FROM p WHERE len(path) > 1 AND here IN (SELECT id FROM t) QUALIFY row_number() OVER (PARTITION BY source, here ORDER BY len(path), path) <= {BETWEEN[3]}""")
def paths_between_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths between a stated set of sources and one of targets, over all lines; paths grow only where they can arrive."""
    with adapters.all_lines():
        entity, edge = graph_queries.both(spark, sf_dir)
    found = graph.all_paths(spark, edge, entity.where(BETWEEN[0]), entity.where(BETWEEN[1]), BETWEEN[2], BETWEEN[3])
    return found.select("source", "target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(ORACLES["paths_between_whole"].replace(f"<= {BETWEEN[3]}", "<= 1"))
def shortest_paths_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path between each source and target, the least where several are as short."""
    with adapters.all_lines():
        entity, edge = graph_queries.both(spark, sf_dir)
    found = graph.all_paths(spark, edge, entity.where(BETWEEN[0]), entity.where(BETWEEN[1]), BETWEEN[2], 1)
    return found.select("source", "target", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))
