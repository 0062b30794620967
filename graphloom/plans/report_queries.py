"""Reports and grounding facts: stored, read back by path, and made of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import graph, kpi, metrics, reports, retrieval
from graphloom.plans.graph_queries import WITH, both
from graphloom.plans.metric_queries import AFFECTED_SQL, MEASURED_SQL, SEED, _coupling_sql, risks
from graphloom.plans.metric_queries import ORACLES as METRIC_ORACLES
from graphloom.plans.registry import registry
from graphloom.sources import adapters
from graphloom.tables import fresh_folder, table

QUERIES, ORACLES, query = registry()
LABEL_SQL = "CASE WHEN kind = 'ENDPOINT' THEN name ELSE qualified_name END"
WHOLE = WITH.replace(f"a.l_quantity >= {adapters.QUANTITY} AND b.l_quantity >= {adapters.QUANTITY} AND ", "")


@query(f"""{WITH}, n AS (SELECT parent_id AS id, count(*) AS members FROM entity WHERE parent_id IS NOT NULL GROUP BY 1),
r AS (SELECT file_id % 40 AS project_id, id AS entity_id, make_timestamp((1700000000 + (id * 7919) % 100000)::BIGINT * 1000000) AS created_at, id % 2 AS half, {LABEL_SQL} AS label, stereotype AS role, complexity, coalesce(members, 0)::INT AS members FROM entity LEFT JOIN n USING (id) WHERE parent_id IS NULL)
SELECT project_id::BIGINT AS project_id, row_number() OVER (PARTITION BY project_id ORDER BY half, created_at, entity_id) AS report_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, half DESC, entity_id DESC)::INT AS place, entity_id, label, role, complexity, members, 'About ' || label AS summary
FROM r QUALIFY place <= 20""")
def reports_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report on every type, stored in two lots; of each project the latest 20, with fields read from their facts."""
    entity = adapters.entities(spark, sf_dir)
    members = entity.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("members"))
    label = fn.label("qualified_name", "kind", "name")
    facts = F.to_json(F.struct(F.struct(label.alias("label"), F.col("stereotype").alias("role")).alias("target"), F.struct("complexity", F.coalesce("members", F.lit(0)).alias("members")).alias("figures")))
    rows = entity.where("parent_id is null").join(members, "id", "left").select(
        (F.col("file_id") % 40).cast("long").alias("project_id"), F.col("id").alias("entity_id"), F.lit("IMPACT").alias("kind"), facts.alias("facts"), F.concat(F.lit("About "), label).alias("summary"), F.lit("none").alias("model"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 100_000).alias("created_at"),
    )
    kept = reports.Reports(spark, fresh_folder(spark))
    for half in (0, 1):
        kept.save(rows.where(F.col("entity_id") % 2 == half))
    return kept.latest().select("project_id", "report_id", "place", "entity_id", reports.field("$.target.label").alias("label"), reports.field("$.target.role").alias("role"), reports.field("$.figures.complexity", "int").alias("complexity"), reports.field("$.figures.members", "int").alias("members"), "summary")


PATHS_SQL = METRIC_ORACLES["impact_paths"]
_paths_with, _paths_end = PATHS_SQL[: PATHS_SQL.rindex("SELECT w.id")], PATHS_SQL[PATHS_SQL.rindex("SELECT w.id") :]
#: The walk with labels instead of numbers.
_paths_with = _paths_with.replace("CASE WHEN w.flag THEN '! ' ELSE ' ' END || w.node || w.path", "'- ' || l.label || w.path").replace("' ' || t.via[3] || '- '", "' <-' || CASE WHEN w.flag THEN 'dispatch' ELSE lower(t.via[3]) END || '- '").replace("FROM walk w JOIN tree t ON t.node = w.node AND t.flag = w.flag)", "FROM walk w JOIN tree t ON t.node = w.node AND t.flag = w.flag JOIN labelled l ON l.id = w.node)")
_paths_with = _paths_with.replace("tree AS (SELECT", f"labelled AS (SELECT id, {LABEL_SQL} AS label FROM entity), tree AS (SELECT")
_rest = AFFECTED_SQL[len(WITH) :]
DIGEST_SQL = f"""{_paths_with.replace("r AS (SELECT id AS node", "rp AS (SELECT id AS node").replace("FROM r JOIN steps", "FROM rp r JOIN steps").replace("FROM r GROUP BY ALL", "FROM rp GROUP BY ALL")}{_rest.replace(_rest[_rest.index(", seed AS"):_rest.index("r AS (SELECT id AS node")], ", ")},
how AS (SELECT w.id, t.via[3] AS type, l.label || w.path AS path FROM walk w JOIN tree t ON t.node = w.id AND NOT t.flag JOIN seed s ON s.id = w.node AND NOT w.flag JOIN labelled l ON l.id = w.node),
named AS (SELECT a.*, e.name, l.label FROM affected a JOIN entity e USING (id) JOIN labelled l USING (id)),
near AS (SELECT *, row_number() OVER (ORDER BY depth, name, id) AS place FROM named WHERE NOT test QUALIFY place <= 25),
ends AS (SELECT *, row_number() OVER (ORDER BY depth, name, id) AS place FROM named WHERE NOT test AND kind = 'ENDPOINT' QUALIFY place <= 15),
typed AS (SELECT DISTINCT coalesce(role, 'OTHER') AS role, owner_id FROM affected WHERE NOT test AND owner_id NOT IN (SELECT id FROM seed)),
types AS (SELECT role, label, row_number() OVER (PARTITION BY role ORDER BY label, id) AS place FROM typed JOIN labelled ON id = owner_id QUALIFY place <= 10),
tested AS (SELECT label, row_number() OVER (ORDER BY label, id) AS place FROM (SELECT DISTINCT owner_id FROM affected WHERE test) JOIN labelled ON id = owner_id QUALIFY place <= 15)
SELECT 'affected' AS part, place::INT - 1 AS place, near.label || '|' || depth || '|' || type || '|' || path AS text FROM near JOIN how USING (id)
UNION ALL SELECT 'endpoint', place::INT - 1, label FROM ends UNION ALL SELECT 'type ' || role, place::INT - 1, label FROM types UNION ALL SELECT 'test', place::INT - 1, label FROM tested
UNION ALL SELECT 'total', 0, count(*)::VARCHAR FROM affected WHERE NOT test UNION ALL SELECT 'direct', 0, count(*)::VARCHAR FROM affected WHERE NOT test AND depth = 1"""


@query(DIGEST_SQL)
def report_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of an impact report, read back item by item: figures, lists of labels, and how a change gets to the nearest."""
    entity, edge = both(spark, sf_dir)
    top = spark.range(1).selectExpr("100L max_dependents", "10L max_depth", "50L max_coupling", "1000L max_complexity")
    facts = reports.impact_facts(spark, entity, edge, entity.where(SEED), top).select(F.parse_json("facts").alias("facts"))
    at = lambda path, kind: F.variant_get("facts", path, kind)
    listed = lambda part, path: facts.select(F.lit(part).alias("part"), F.posexplode(at(path, "array<string>")).alias("place", "text"))
    near = facts.select(F.lit("affected").alias("part"), F.posexplode(at("$.affected", "array<struct<entity:string,depth:int,via:string,path:string>>")).alias("place", "x"))
    near = near.select("part", "place", F.concat_ws("|", "x.entity", F.col("x.depth").cast("string"), "x.via", "x.path").alias("text"))
    types = facts.select(F.explode(at("$.affectedTypes", "map<string,array<string>>")).alias("role", "labels")).select(F.concat(F.lit("type "), "role").alias("part"), F.posexplode("labels").alias("place", "text"))
    figures = [facts.select(F.lit(p).alias("part"), F.lit(0).alias("place"), at(path, "string").alias("text")) for p, path in (("total", "$.transitiveDependents"), ("direct", "$.directDependents"))]
    out = near
    for more in (listed("endpoint", "$.affectedEndpoints"), types, listed("test", "$.testsToRun"), *figures):
        out = out.unionByName(more)
    return out


@query(f"""{MEASURED_SQL}, cyc AS (SELECT component, m.id FROM mutual m JOIN entity t ON t.id = m.id AND t.parent_id IS NULL QUALIFY count(*) OVER (PARTITION BY component) > 1),
e AS (SELECT *, {LABEL_SQL} AS label FROM entity), rk AS (SELECT package_name, label || ' (risk ' || floor(risk + 0.5::DOUBLE)::BIGINT || ', ' || dependents || ' dependents)' AS text, row_number() OVER (PARTITION BY package_name ORDER BY risk DESC, id) AS n FROM e JOIN scored USING (id) WHERE e.kind IN ('CLASS', 'INTERFACE', 'METHOD', 'CONSTRUCTOR') QUALIFY n <= 5),
en AS (SELECT package_name, name || ' -> ' || qualified_name AS text, row_number() OVER (PARTITION BY package_name ORDER BY id) AS n FROM e WHERE kind = 'ENDPOINT' QUALIFY n <= 25),
ro AS (SELECT package_name, string_agg(role || '=' || n, ',' ORDER BY role) AS roles FROM (SELECT package_name, coalesce(stereotype, 'OTHER') AS role, count(*) AS n FROM e WHERE kind IN ('CLASS', 'INTERFACE') GROUP BY ALL) GROUP BY 1)
SELECT package_name AS project, count_if(kind IN ('CLASS', 'INTERFACE'))::INT AS types, count_if(kind = 'METHOD')::INT AS methods, count(DISTINCT file_id)::INT AS files, any_value(ro.roles) AS roles,
  (SELECT string_agg(text, ';' ORDER BY n) FROM rk WHERE rk.package_name = e.package_name) AS riskiest, (SELECT string_agg(text, ';' ORDER BY n) FROM en WHERE en.package_name = e.package_name) AS endpoints,
  (SELECT count(DISTINCT component)::INT FROM cyc JOIN e x USING (id) WHERE x.package_name = e.package_name) AS cycles
FROM e LEFT JOIN ro USING (package_name) GROUP BY package_name""".replace("CASE WHEN kind", "CASE WHEN entity.kind"))
def grounding_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer about a project rests on, packages as projects, read back from the facts; cycles are those of types."""
    entity, edge = both(spark, sf_dir)
    cycles = graph.cycles(spark, entity.where("parent_id is null"), graph.roll_up(entity, edge)).select(F.col("component").alias("cycle"), F.explode("members").alias("id")).join(entity.select("id", "package_name"), "id")
    facts = reports.project_facts(entity, risks(spark, sf_dir), cycles, "package_name").select("project", F.parse_json("facts").alias("f"))
    at = lambda path, kind: F.try_variant_get("f", path, kind)
    roles = F.array_join(F.transform(F.array_sort(F.map_entries(at("$.roles", "map<string,int>"))), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return facts.select("project", at("$.stats.types", "int").alias("types"), at("$.stats.methods", "int").alias("methods"), at("$.stats.files", "int").alias("files"), roles.alias("roles"), F.array_join(at("$.riskiest", "array<string>"), ";").alias("riskiest"), F.array_join(at("$.endpoints", "array<string>"), ";").alias("endpoints"), at("$.dependencyCycles", "int").alias("cycles"))


def _near_sql(frm: str, to: str) -> str:
    return f"(SELECT of, array_to_string(list_concat(a[1:12], CASE WHEN len(a) > 12 THEN ['... and ' || (len(a) - 12) || ' more'] ELSE [] END), ';') AS x FROM (SELECT {frm} AS of, list_sort(list(DISTINCT label || ' (' || replace(lower(type), '_', ' ') || ')')) AS a FROM edge JOIN l ON l.id = {to} GROUP BY 1))"


@query(f"""{WHOLE}, l AS (SELECT id, {LABEL_SQL} AS label FROM entity), m AS (SELECT parent_id AS of, list(label ORDER BY id) AS a FROM entity JOIN l USING (id) WHERE parent_id IS NOT NULL AND kind <> 'FIELD' GROUP BY 1)
SELECT e.id, o.stereotype AS role, e.complexity::INT AS complexity, coalesce(i.x, '') AS dependents, coalesce(d.x, '') AS dependencies, CASE WHEN e.parent_id IS NULL THEN coalesce(array_to_string(m.a[1:25], ';'), '') END AS members
FROM entity e JOIN entity o ON o.id = coalesce(e.parent_id, e.id) LEFT JOIN {_near_sql("dst", "src")} i ON i.of = e.id LEFT JOIN {_near_sql("src", "dst")} d ON d.of = e.id LEFT JOIN m ON m.of = e.id""")
def grounding_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer about an entity rests on, for all entities and all lines, read back from the facts."""
    with adapters.all_lines():
        entity, edge = both(spark, sf_dir)
    zero = F.lit(0).cast("long")
    measured = entity.select("id", *(zero.alias(c) for c in ("fan_in", "fan_out", "dependents", "dependencies", "depth")), "complexity", F.lit(0.0).alias("risk"))
    facts = reports.entity_facts(entity, measured, edge).select("id", F.parse_json("facts").alias("f"))
    at = lambda path, kind: F.try_variant_get("f", path, kind)
    return facts.select("id", at("$.role", "string").alias("role"), at("$.metrics.complexity", "int").alias("complexity"), *(F.array_join(at(f"$.{c}", "array<string>"), ";").alias(c) for c in ("dependents", "dependencies", "members")))


@query(f"""{MEASURED_SQL}, r AS (SELECT s.* FROM scored s WHERE kind IN ('CLASS', 'INTERFACE', 'METHOD', 'CONSTRUCTOR')),
cyc AS (SELECT m.id FROM mutual m JOIN entity t ON t.id = m.id AND t.parent_id IS NULL QUALIFY count(*) OVER (PARTITION BY component) > 1)
SELECT (SELECT count(*) FROM r) AS scored, (SELECT floor(count_if(level = 'LOW')::DOUBLE / count(*)::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE FROM r) AS low_share, (SELECT count_if(kind IN ('METHOD', 'CONSTRUCTOR') AND complexity >= 10)::BIGINT FROM r) AS complex_methods,
(SELECT count(*) FROM entity WHERE kind IN ('CLASS', 'INTERFACE') AND coalesce(stereotype, '') <> 'TEST') AS production_types, (SELECT count(DISTINCT id) FROM cyc) AS cycle_types""")
def overview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    cycles = graph.cycles(spark, entity.where("parent_id is null"), graph.roll_up(entity, edge))
    return kpi.page(entity, risks(spark, sf_dir), cycles.select(F.explode("members").alias("id")))


@query(_coupling_sql("package_name").replace(f"a.l_quantity >= {adapters.QUANTITY} AND b.l_quantity >= {adapters.QUANTITY} AND ", "") + " ORDER BY distance DESC, grp LIMIT 8")
def worst_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    with adapters.all_lines():
        return kpi.worst_groups(metrics.coupling(*both(spark, sf_dir), "package_name"))


@query("""WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS number, role, turn, text FROM conversations),
b AS (SELECT conv_id, number, '[' || number || '] ' || coalesce(role, '') || ' (' || 'TURN' || ') - ' || 'conv/' || conv_id || ':' || turn || '-' || (turn + 1) || chr(10) || '```java' || chr(10) || coalesce(text, '') || chr(10) || '```' AS block FROM n),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY conv_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS upto FROM b)
SELECT conv_id, number::INT AS number, left(block, 600) AS block FROM u WHERE upto <= 600 OR number = 1""")
def prompt_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as the sources of a prompt, with their headings and numbers within the budget."""
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", F.struct("turn", "text").alias("place"), F.col("role").alias("label"), F.lit("TURN").alias("kind"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("path"), F.col("turn").alias("start_line"), (F.col("turn") + 1).alias("end_line"), "text")
    return retrieval.prompt_blocks(rows, 600, "conv_id")


ERROR_SQL = "CASE WHEN text IS NULL THEN 'unreadable' WHEN length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) THEN 'unbalanced' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.char_length("text") - F.char_length(F.replace("text", F.lit(c), F.lit("")))
    error = F.when(F.col("text").isNull(), "unreadable").when(n("(") != n(")"), "unbalanced")
    return table(spark, sf_dir, "documents").select("source", F.coalesce(fn.lines_of_code("text"), F.lit(0)).alias("loc"), error.alias("parse_error"))


@query(f"""WITH f AS (SELECT source, {ERROR_SQL} AS parse_error, coalesce(len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[ \\t\\n\\f\\r\\x0B]+', '', 'g')) > 0)), 0) AS loc FROM documents)
SELECT source, count(*) AS files, sum(loc)::BIGINT AS loc, count(parse_error) AS parse_errors FROM f GROUP BY 1""")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; unbalanced brackets stand for what a parser reports."""
    return kpi.file_stats(_files(spark, sf_dir), "source")


@query(f"{WHOLE} SELECT (SELECT count(*) FROM entity) AS entities, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM entity WHERE kind = 'ENDPOINT') AS endpoints, (SELECT count({ERROR_SQL}) FROM documents) AS parse_errors")
def scalar_counts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    with adapters.all_lines():
        entity, edge = both(spark, sf_dir)
    return kpi.scalar_counts(entity, edge, _files(spark, sf_dir))
