"""Look-ups, nesting, batches and stores, on the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph, impact, kpi, metrics, retrieval, search
from graphloom.plans.graph_queries import WITH, both
from graphloom.plans.metric_queries import _coupling_sql
from graphloom.plans.registry import registry
from graphloom.sources import adapters
from graphloom.tables import table

QUERIES, ORACLES, query = registry()
#: Entities nested as deep as numbers have digits to base 3: types where 5 divides the number.
NEST_SQL = "nest AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 3 THEN p_partkey // 3 END AS parent_id, CASE WHEN p_partkey % 5 = 0 OR p_partkey < 2 THEN 'CLASS' ELSE 'METHOD' END AS kind FROM part)"


def nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.when(k >= 3, F.floor(k / 3)).cast("long").alias("parent_id"), F.when((k % 5 == 0) | (k < 2), "CLASS").otherwise("METHOD").alias("kind"))


@query(f"""WITH RECURSIVE {NEST_SQL}, walk AS (SELECT id, id AS at FROM nest UNION ALL SELECT w.id, n.parent_id FROM walk w JOIN nest n ON n.id = w.at WHERE n.kind <> 'CLASS' AND n.parent_id IS NOT NULL)
SELECT n.id, max(CASE WHEN t.kind = 'CLASS' THEN t.id END) AS owner_id FROM nest n JOIN walk w ON w.id = n.id LEFT JOIN nest t ON t.id = w.at GROUP BY n.id""")
def owner_walk_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of members that are nested many levels deep."""
    return graph.owners(nest(spark, sf_dir))


@query(f"""WITH RECURSIVE {NEST_SQL}, down AS (SELECT id FROM nest WHERE id IN (7, 11) UNION SELECT n.id FROM nest n JOIN down d ON n.parent_id = d.id) SELECT id FROM down""")
def impact_seeds_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entities and all that they contain, at any depth."""
    entity = nest(spark, sf_dir)
    return impact.seeds_of_entity(entity, entity.where("id in (7, 11)"))


@query(f"""{WITH}, f AS (SELECT DISTINCT file_id FROM entity WHERE file_id % 3 = 1) SELECT file_id, min(CASE WHEN kind IN ('CLASS', 'INTERFACE') THEN id END) AS target, sum(CASE WHEN kind IN ('CLASS', 'INTERFACE') THEN complexity ELSE 0 END)::BIGINT AS complexity, count(*) AS seeds
FROM entity WHERE file_id IN (SELECT file_id FROM f) GROUP BY 1 HAVING min(CASE WHEN kind IN ('CLASS', 'INTERFACE') THEN id END) IS NOT NULL""")
def impact_file_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = adapters.entities(spark, sf_dir)
    return impact.targets_of_files(entity, entity.where("file_id % 3 = 1"))


@query(f"""{WITH} SELECT a.id + 1 AS place, e.id, e.name, CASE WHEN e.kind = 'ENDPOINT' THEN e.name ELSE e.qualified_name END AS label,
    e.kind, o.stereotype AS role, CASE WHEN e.complexity > 30 THEN e.complexity::DOUBLE END AS risk FROM entity a JOIN entity e ON e.id = a.id LEFT JOIN entity o ON o.id = coalesce(e.parent_id, e.id) WHERE a.id % 100 = 0""")
def entity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a set of ids, each with its place in the list that was asked for."""
    entity = adapters.entities(spark, sf_dir)
    asked = entity.where("id % 100 = 0").select((F.col("id") + 1).alias("place"), "id")
    return search.summaries(entity, entity.where("complexity > 30").select("id", F.col("complexity").cast("double").alias("risk")), asked)


@query(f"{WITH} SELECT id, name, kind FROM entity WHERE qualified_name IN (SELECT p_brand || '.' || p_name FROM part WHERE p_partkey % 10 = 0)")
def entity_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"))
    return search.by_name(adapters.entities(spark, sf_dir), asked).select("id", "name", "kind")


@query(f"{WITH} SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY complexity, id)::INT AS place, id, name FROM entity WHERE parent_id IS NOT NULL")
def entity_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by line (a part's size stands for it)."""
    entity = adapters.entities(spark, sf_dir).withColumn("start_line", F.col("complexity"))
    return search.children(entity, entity.where("parent_id is null"))


@query(f"{WITH}, hit AS (SELECT p_partkey AS ref, CASE WHEN p_partkey % 4 = 0 THEN 'gone.' ELSE '' END || p_brand || '.' || p_name AS qualified_name FROM part) SELECT h.ref, h.qualified_name, e.id AS entity_id FROM hit h LEFT JOIN entity e USING (qualified_name)")
def hits_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a search with the entities that they name; names that are gone stay without one."""
    k = F.col("p_partkey")
    hits = table(spark, sf_dir, "part").select(k.alias("ref"), F.concat(F.when(k % 4 == 0, "gone.").otherwise(""), F.concat_ws(".", "p_brand", "p_name")).alias("qualified_name"))
    return search.linked(hits, adapters.entities(spark, sf_dir))


@query(f"{WITH} SELECT id, CASE WHEN parent_id IS NULL OR complexity >= 40 THEN id ELSE parent_id END AS focus FROM entity")
def focus_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centre of a view of types and large members: an entity itself where it is shown, or else its type."""
    entity = adapters.entities(spark, sf_dir)
    return search.focused(entity, entity.where("parent_id is null or complexity >= 40"), entity)


@query(f"SELECT grp, instability, row_number() OVER (ORDER BY instability DESC, grp)::INT AS place FROM ({_coupling_sql('package_name')})")
def modules_by_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.modules_by_instability(metrics.coupling(*both(spark, sf_dir), "package_name")).select("grp", "instability", "place")


@query("SELECT user_id AS project_id, event_id AS report_id, ts AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM events WHERE event_type = 'click' QUALIFY place <= 20")
def reports_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("report_id"), F.col("ts").alias("created_at"))
    return kpi.latest_reports(reports)


@query("""WITH RECURSIVE f AS (SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, (n_chars // 100)::BIGINT AS chunks FROM documents WHERE n_chars >= 100), o AS (SELECT *, row_number() OVER (ORDER BY path) AS n FROM f),
walk AS (SELECT n, path, chunks AS used, 0::BIGINT AS batch FROM o WHERE n = 1 UNION ALL SELECT o.n, o.path, CASE WHEN w.used + o.chunks > 300 THEN o.chunks ELSE w.used + o.chunks END, CASE WHEN w.used + o.chunks > 300 THEN w.batch + 1 ELSE w.batch END
    FROM walk w JOIN o ON o.n = w.n + 1) SELECT path, batch FROM walk""")
def index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files in order of path, at most 300 chunks a batch."""
    files = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.floor(F.col("n_chars") / 100).alias("chunks"))
    return retrieval.batches(files)


@query(f"{WITH} SELECT (SELECT count(*) FROM entity) AS entities, (SELECT count(*) FROM edge) AS edges, (SELECT count(DISTINCT file_id) FROM entity) AS files, (SELECT count(*) FROM entity WHERE kind = 'ENDPOINT') AS endpoints")
def scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    counts = entity.agg(F.count("*").alias("entities"), F.count_distinct("file_id").alias("files"), F.count_if(F.col("kind") == "ENDPOINT").alias("endpoints"))
    return counts.join(edge.agg(F.count("*").alias("edges")), how="cross")  # rows of one


@query(f"""{WITH}, f AS (SELECT DISTINCT doc_id * 2 AS file_id, 'src/' || coalesce(source, 'none') || '/D' || doc_id || '.java' AS path, source AS module FROM documents)
SELECT e.id, e.kind, e.qualified_name, f.path, coalesce(f.module, e.module) AS module FROM entity e LEFT JOIN f ON f.file_id = e.file_id""")
def node_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their files: documents stand for those with even numbers, the others are unknown."""
    k = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select((k * 2).alias("file_id"), F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/D"), k.cast("string"), F.lit(".java")).alias("path"), F.col("source").alias("module")).distinct()
    return search.nodes(adapters.entities(spark, sf_dir), files).select("id", "kind", "qualified_name", "path", "module")


@query("""WITH p AS (SELECT c_custkey AS project_id, CASE WHEN c_custkey % 10 <> 0 THEN n_name END AS owner FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT owner, count(DISTINCT project_id) AS projects, count(*) AS runs, sum(o_totalprice > 100000)::BIGINT AS large FROM orders JOIN p ON o_custkey = project_id WHERE owner IN (SELECT n_name FROM nation WHERE n_regionkey = 1) GROUP BY 1""")
def owner_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owners of one region may see of all runs: their own projects'. Every tenth project is nobody's."""
    t = lambda n: table(spark, sf_dir, n)
    projects = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 10 != 0, F.col("n_name")).alias("owner"))
    runs = t("orders").select(F.col("o_custkey").alias("project_id"), "o_totalprice")
    mine = search.owned(runs, projects, t("nation").where("n_regionkey = 1").select(F.col("n_name").alias("owner")))
    return mine.groupBy("owner").agg(F.count_distinct("project_id").alias("projects"), F.count("*").alias("runs"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))
