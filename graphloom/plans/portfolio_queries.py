"""Portfolio figures: events are runs of projects, parts are entities, brands are projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import kpi, search
from graphloom.plans.graph_queries import WITH, both
from graphloom.plans.registry import registry
from graphloom.sources import adapters
from graphloom.tables import mean, rounded, table

QUERIES, ORACLES, query = registry()
RUNS = f"WITH {adapters.RUNS_SQL}"
LAST_DAY = "2024-01-30"
DAYS_SQL = f"""{RUNS}, spine AS (SELECT unnest(generate_series(DATE '{LAST_DAY}' - 13, DATE '{LAST_DAY}', INTERVAL 1 DAY))::DATE AS day),
d AS (SELECT started_at::DATE AS day, count_if(status = 'SUCCESS')::BIGINT AS ok, count_if(status = 'FAILED')::BIGINT AS failed, floor(avg(duration_ms) + 0.5::DOUBLE)::BIGINT AS avg_ms FROM runs GROUP BY 1),
days AS (SELECT s.day, coalesce(d.ok, 0)::BIGINT AS ok, coalesce(d.failed, 0)::BIGINT AS failed, d.avg_ms FROM spine s LEFT JOIN d USING (day))"""


@query(f"""{WITH} SELECT package_name, count_if(kind IN ('CLASS', 'INTERFACE'))::BIGINT AS types, count_if(kind = 'METHOD')::BIGINT AS methods, count_if(kind = 'ENDPOINT')::BIGINT AS endpoints,
count_if(kind IN ('CLASS', 'INTERFACE') AND stereotype = 'TEST')::BIGINT AS tests FROM entity GROUP BY 1""")
def kpi_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.entity_counts(adapters.entities(spark, sf_dir), "package_name")


@query("SELECT source, count(*) AS files, coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents GROUP BY 1")
def kpi_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


@query(f"{WITH} SELECT n.package_name, count(*) AS edges FROM edge e JOIN entity n ON e.src = n.id GROUP BY 1")
def kpi_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    return edge.join(entity.select(F.col("id").alias("src"), "package_name"), "src").groupBy("package_name").agg(F.count("*").alias("edges"))


@query(f"{RUNS} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id DESC) = 1")
def kpi_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.last_runs(adapters.runs(spark, sf_dir))


@query(f"{RUNS} SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id DESC) <= 20")
def kpi_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.last_runs(adapters.runs(spark, sf_dir), 20)


@query(f"{DAYS_SQL} SELECT * FROM days")
def kpi_activity_14d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.activity(adapters.runs(spark, sf_dir), LAST_DAY)


@query(f"{DAYS_SQL} SELECT CASE WHEN sum(ok + failed) > 0 THEN (sum(avg_ms * (ok + failed)) // sum(ok + failed))::BIGINT END AS mean_ms FROM days WHERE avg_ms IS NOT NULL")
def kpi_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.weighted_mean(kpi.activity(adapters.runs(spark, sf_dir), LAST_DAY))


@query(f"""{RUNS}, n AS (SELECT project_id, count(*) AS n FROM runs GROUP BY 1), l AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id DESC) = 1)
SELECT count(*) AS projects, sum(n.n)::BIGINT AS rows, count_if(status = 'RUNNING')::BIGINT AS running, count_if(status = 'SUCCESS')::BIGINT AS ready, count_if(status = 'FAILED')::BIGINT AS failed FROM n LEFT JOIN l USING (project_id)""")
def kpi_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.runs(spark, sf_dir)
    return kpi.totals(runs.groupBy("project_id").agg(F.count("*").alias("n")), kpi.last_runs(runs))


@query(f"""{DAYS_SQL}, last_run AS (SELECT project_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id DESC) = 1),
seen AS (SELECT user_id AS project_id, count(*) AS files, sum(floor(value))::BIGINT AS loc, count_if(event_type = 'click')::BIGINT AS types, count_if(event_type = 'view')::BIGINT AS methods, count_if(event_type = 'purchase')::BIGINT AS endpoints,
    count_if(event_type = 'error')::BIGINT AS tests, count(DISTINCT event_type) AS edges, count_if(value >= 50)::BIGINT AS high, count_if(value >= 20 AND value < 50)::BIGINT AS medium, count_if(value < 20)::BIGINT AS low FROM events GROUP BY 1)
SELECT count(*) AS projects, count_if(status = 'SUCCESS')::BIGINT AS ready, count_if(status = 'RUNNING')::BIGINT AS analyzing, count_if(status = 'FAILED')::BIGINT AS failed, sum(files)::BIGINT AS files, sum(loc)::BIGINT AS loc, sum(types)::BIGINT AS types,
    sum(methods)::BIGINT AS methods, sum(endpoints)::BIGINT AS endpoints, sum(tests)::BIGINT AS tests, sum(edges)::BIGINT AS edges, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low, (SELECT sum(ok + failed)::BIGINT FROM days) AS runs,
    (SELECT sum(failed)::BIGINT FROM days) AS failed_runs, (SELECT (sum(avg_ms * (ok + failed)) // sum(ok + failed))::BIGINT FROM days WHERE avg_ms IS NOT NULL) AS mean_ms FROM seen LEFT JOIN last_run USING (project_id)""")
def kpi_portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are projects: what they did stands for their figures."""
    kind, value = F.col("event_type"), F.col("value")
    n = lambda c: F.count_if(c)
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("project_id")).agg(
        F.count("*").alias("files"), F.sum(F.floor("value")).alias("loc"), n(kind == "click").alias("types"), n(kind == "view").alias("methods"), n(kind == "purchase").alias("endpoints"), n(kind == "error").alias("tests"), F.count_distinct("event_type").alias("edges"),
        n(value >= 50).alias("high"), n((value >= 20) & (value < 50)).alias("medium"), n(value < 20).alias("low"),
    )
    runs = adapters.runs(spark, sf_dir)
    state = F.when(F.col("status") == "SUCCESS", "READY").otherwise(F.col("status"))
    rows = seen.join(kpi.last_runs(runs).select("project_id", "status"), "project_id", "left").withColumn("analyzing", F.coalesce(F.col("status") == "RUNNING", F.lit(False))).withColumn("status", state)
    return kpi.portfolio_totals(rows, kpi.activity(runs, LAST_DAY))


@query(f"""{RUNS}, o AS (SELECT *, lag(duration_ms) OVER (PARTITION BY project_id ORDER BY started_at, run_id) AS before FROM runs WHERE status = 'SUCCESS')
SELECT project_id, duration_ms, duration_ms - before AS change FROM o QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id DESC) = 1""")
def kpi_run_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.run_change(adapters.runs(spark, sf_dir))


@query(f"""{WITH} SELECT kind, CASE WHEN parent_id IS NULL THEN coalesce(stereotype, 'OTHER') END AS role, count(*) AS n, count(DISTINCT module) AS modules, count(DISTINCT package_name) AS packages FROM entity GROUP BY ALL""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("parent_id").isNull(), F.coalesce("stereotype", F.lit("OTHER")))
    return adapters.entities(spark, sf_dir).groupBy("kind", role.alias("role")).agg(F.count("*").alias("n"), F.count_distinct("module").alias("modules"), F.count_distinct("package_name").alias("packages"))


@query(f"""{WITH} SELECT floor(sum(complexity)::DOUBLE / count(complexity)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS mean_complexity, max(complexity) AS max_complexity, count_if(complexity >= 10)::BIGINT AS complex_methods,
count_if(complexity >= 20)::BIGINT AS bucket_20 FROM entity WHERE kind = 'METHOD'""")
def overview_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = adapters.entities(spark, sf_dir).where("kind = 'METHOD'")
    return methods.agg(rounded(mean(F.col("complexity"))).alias("mean_complexity"), F.max("complexity").alias("max_complexity"), F.count_if(F.col("complexity") >= 10).alias("complex_methods"), F.count_if(F.col("complexity") >= 20).alias("bucket_20"))


@query(f"{WITH} SELECT id, name, kind, complexity FROM entity WHERE kind IN ('CLASS', 'INTERFACE') ORDER BY complexity DESC, id LIMIT 8")
def portfolio_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.hotspots(adapters.entities(spark, sf_dir), "complexity", 8, ("CLASS", "INTERFACE")).select("id", "name", "kind", "complexity")


@query("""SELECT max(files) AS max_files, max(chars)::BIGINT AS max_chars, sum(files)::BIGINT AS files FROM (SELECT source, count(*) AS files, sum(n_chars) AS chars FROM documents GROUP BY 1)""")
def portfolio_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi_files(spark, sf_dir).agg(F.max("files").alias("max_files"), F.max("chars").alias("max_chars"), F.sum("files").alias("files"))


@query("SELECT r_name AS owner, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, max(o_totalprice) AS peak FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE r_regionkey IN (1, 2) GROUP BY 1")
def owner_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of two owners' projects: owner to project to runs, with the small tables broadcast by size."""
    t = lambda n: table(spark, sf_dir, n)
    own = t("region").where("r_regionkey in (1, 2)").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = t("customer").join(own, F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy(F.col("r_name").alias("owner")).agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.max("o_totalprice").alias("peak"))


@query(f"""{WITH}, hit AS (SELECT *, CASE WHEN lower(name) = 'red' THEN 0 WHEN starts_with(lower(name), 'red') THEN 1 ELSE 2 END AS rank FROM entity WHERE contains(lower(name), 'red') OR contains(lower(qualified_name), 'red'))
SELECT id, name, kind, rank FROM hit ORDER BY rank, length(name), name, id LIMIT 40""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(adapters.entities(spark, sf_dir), " Red ", n=40).select("id", "name", "kind", "rank")


@query(f"""{WITH}, r AS (SELECT src AS id, 'out' AS way, type, dst AS other FROM edge UNION ALL SELECT dst, 'in', type, src FROM edge),
p AS (SELECT r.*, row_number() OVER (PARTITION BY r.id, way ORDER BY type, e.name, other) AS place FROM r JOIN entity e ON e.id = r.other) SELECT id, way, type, other, place::INT AS place FROM p WHERE place <= 200""")
def relations_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.relations(*both(spark, sf_dir), 200)


@query(f"{WITH} SELECT type, 'out' AS way, count(*) AS n FROM edge GROUP BY 1 UNION ALL SELECT type, 'in', count(*) FROM edge GROUP BY 1")
def relation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    return search.relation_groups(edge, entity)


@query(f"""{WITH}, n AS (SELECT src AS id, list_sort(list(DISTINCT e.name)) AS a FROM edge JOIN entity e ON dst = e.id GROUP BY src)
SELECT id, array_to_string(a[1:12], ', ') || CASE WHEN len(a) > 12 THEN ', … and ' || (len(a) - 12) || ' more' ELSE '' END AS labels FROM n""")
def neighbor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.neighbour_labels(*both(spark, sf_dir), 12)


@query(f"""{WITH}, m AS (SELECT parent_id AS id, count(*) AS n FROM entity WHERE parent_id IS NOT NULL GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM edge GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM edge GROUP BY 1)
SELECT e.id, e.kind, CASE WHEN e.complexity > 30 THEN e.complexity::DOUBLE ELSE 0.0::DOUBLE END AS risk, p.name AS parent_name, coalesce(m.n, 0)::BIGINT AS members, coalesce(o.n, 0)::BIGINT AS n_out, coalesce(i.n, 0)::BIGINT AS n_in
FROM entity e LEFT JOIN entity p ON e.parent_id = p.id LEFT JOIN m ON m.id = e.id LEFT JOIN o ON o.id = e.id LEFT JOIN i ON i.id = e.id""")
def entity_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    return search.details(entity, entity.where("complexity > 30").select("id", F.col("complexity").cast("double").alias("risk")), edge)


FILES_SQL = """stored AS (SELECT doc_id AS path, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 5 <> 0),
scanned AS (SELECT doc_id AS path, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS sha256 FROM documents WHERE doc_id % 3 <> 0)"""


@query(f"""WITH {FILES_SQL} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'changed' END AS change
FROM stored o FULL JOIN scanned n ON o.path = n.path WHERE o.sha256 IS DISTINCT FROM n.sha256""")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.incremental import change_set as diff

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.where("path % 5 <> 0").select("path", F.sha2("text", 256).alias("sha256"))
    scanned = docs.where("path % 3 <> 0").select("path", F.sha2(F.concat("text", F.when(F.col("path") % 7 == 0, "x").otherwise("")), 256).alias("sha256"))
    return diff(stored, scanned)


@query(f"""{WITH} SELECT DISTINCT s.file_id FROM edge e JOIN entity t ON e.dst = t.id JOIN entity s ON e.src = s.id WHERE t.file_id < 5 AND s.file_id >= 5""")
def dependents_of_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.incremental import dependents

    entity, edge = both(spark, sf_dir)
    edge = edge.join(entity.select(F.col("id").alias("src"), "file_id"), "src")
    return dependents(entity, edge, entity.where("file_id < 5").select("file_id").distinct())


@query(f"""{WITH} SELECT e.src, e.dst, e.type, e.weight, s.file_id FROM edge e JOIN entity s ON e.src = s.id JOIN entity t ON e.dst = t.id""")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as stored before an edit of some files, patched: the same as a full run."""
    from graphloom.operators.incremental import patch_edges, patch_entities

    entity, edge = both(spark, sf_dir)
    edge = edge.join(entity.select(F.col("id").alias("src"), "file_id"), "src").select("src", "dst", "type", "weight", "file_id")
    edited = entity.where("file_id % 10 = 4").select("file_id").distinct()
    # before the edit: other complexities and weights in the edited files
    before = entity.withColumn("complexity", F.when(F.col("file_id") % 10 == 4, F.lit(1)).otherwise(F.col("complexity")))
    before_edge = edge.withColumn("weight", F.when(F.col("file_id") % 10 == 4, F.col("weight") + 9).otherwise(F.col("weight")))
    fresh = entity.join(edited, "file_id", "left_semi").drop("id")
    after = patch_entities(before, fresh.select(*[c for c in before.columns if c != "id"]), edited)
    return patch_edges(before_edge, edge.join(edited, "file_id", "left_semi"), edited, after)
