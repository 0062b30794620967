"""Risk, coupling, complexity and impact over the graph of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import impact, metrics
from graphloom.plans.graph_queries import CLOSURE_SQL, MOVES_SQL, SEED, SEED_SQL, WITH, both
from graphloom.plans.registry import registry
from graphloom.sources import adapters

QUERIES, ORACLES, query = registry()


def round_sql(x: str, places: int = 3) -> str:
    return f"floor(({x}) * {10**places}.0::DOUBLE + 0.5::DOUBLE) / {10**places}.0::DOUBLE"


def norm_sql(v: str, m: str) -> str:
    return f"CASE WHEN {v} <= 0 OR {m} <= 0 THEN 0.0::DOUBLE ELSE {round_sql(f'least(1.0::DOUBLE, ln(1 + ({v})::DOUBLE) / ln(1 + ({m})::DOUBLE))')} END"


def risk_sql(dependents: str, depth: str, coupling: str, complexity: str, exposed: str) -> str:
    raw = f"{dependents} * 0.3::DOUBLE + {depth} * 0.15::DOUBLE + {coupling} * 0.2::DOUBLE + {complexity} * 0.2::DOUBLE + {exposed} * 0.15::DOUBLE"
    return f"floor(least(1.0::DOUBLE, {raw}) * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"


#: Tenths are summed as whole numbers: the mean is the same in whatever order rows come.
MEAN_RISK_SQL = "sum(round(risk * 10)::BIGINT)::DOUBLE / (count(risk)::DOUBLE * 10)"
MEASURED_SQL = f"""{WITH}, {adapters.ROLLUP_SQL}, g AS (SELECT * FROM edge UNION ALL SELECT * FROM rolled), {CLOSURE_SQL},
pairs AS (SELECT DISTINCT src, dst FROM g), fi AS (SELECT dst AS id, count(*) AS n FROM pairs GROUP BY 1), fo AS (SELECT src AS id, count(*) AS n FROM pairs GROUP BY 1),
member AS (SELECT e.id, c.reaches_endpoint OR e.kind = 'ENDPOINT' AS exposed, e.parent_id FROM entity e JOIN closure c USING (id) WHERE e.parent_id IS NOT NULL),
inside AS (SELECT parent_id AS id, bool_or(exposed) AS inside FROM member GROUP BY 1),
m AS (SELECT e.id, e.kind, coalesce(fi.n, 0)::BIGINT AS fan_in, coalesce(fo.n, 0)::BIGINT AS fan_out, c.dependents, c.dependencies, d.depth, e.complexity::BIGINT AS complexity,
  CASE WHEN e.parent_id IS NOT NULL THEN mm.exposed ELSE coalesce(i.inside, false) OR coalesce(e.stereotype = 'CONTROLLER', false) END AS exposed
  FROM entity e JOIN closure c USING (id) JOIN depth d USING (id) LEFT JOIN fi USING (id) LEFT JOIN fo USING (id) LEFT JOIN member mm USING (id) LEFT JOIN inside i USING (id)),
top AS (SELECT max(dependents)::BIGINT AS max_dependents, max(depth)::BIGINT AS max_depth, max(fan_in + fan_out)::BIGINT AS max_coupling, max(complexity)::BIGINT AS max_complexity FROM m),
f AS (SELECT m.*, {norm_sql("dependents", "max_dependents")} AS f_dependents, {norm_sql("depth", "max_depth")} AS f_depth, {norm_sql("fan_in + fan_out", "max_coupling")} AS f_coupling,
  {norm_sql("complexity", "max_complexity")} AS f_complexity, CASE WHEN exposed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_exposed FROM m, top),
risks AS (SELECT *, {risk_sql("f_dependents", "f_depth", "f_coupling", "f_complexity", "f_exposed")} AS risk FROM f),
scored AS (SELECT *, CASE WHEN risk >= 60 THEN 'HIGH' WHEN risk >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM risks)"""


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.measured(spark, *both(spark, sf_dir))
    return metrics.scored(found, metrics.scale(found))


@query(f"{MEASURED_SQL} SELECT * FROM scored")
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir)


@query(f"{MEASURED_SQL} SELECT kind, level, count(*) AS n FROM scored GROUP BY ALL")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risks(spark, sf_dir).groupBy("kind", "level").agg(F.count("*").alias("n"))


@query(f"{MEASURED_SQL} SELECT * FROM top")
def project_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scale(metrics.measured(spark, *both(spark, sf_dir)))


@query(f"{MEASURED_SQL} " + " UNION ALL ".join(f"SELECT id, '{n}' AS factor, {round_sql(f'f_{n} * {w}::DOUBLE * 100.0::DOUBLE')} AS points FROM f" for n, w in metrics.WEIGHTS))
def factor_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contributions(risks(spark, sf_dir))


@query(f"{MEASURED_SQL} SELECT id, kind, risk, level FROM scored WHERE kind IN ('CLASS', 'INTERFACE') ORDER BY risk DESC, id LIMIT 20")
def hotspots_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.kpi import hotspots

    return hotspots(risks(spark, sf_dir), "risk", 20, ("CLASS", "INTERFACE")).select("id", "kind", "risk", "level")


@query(f"{MEASURED_SQL} SELECT package_name, count_if(level = 'HIGH')::BIGINT AS high, count_if(level = 'MEDIUM')::BIGINT AS medium, count_if(level = 'LOW')::BIGINT AS low, {round_sql(MEAN_RISK_SQL)} AS avg_risk, max(risk) AS max_risk FROM scored JOIN entity USING (id) GROUP BY 1")
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.kpi import risk_bands

    return risk_bands(risks(spark, sf_dir).join(adapters.entities(spark, sf_dir).select("id", "package_name"), "id"), "package_name")


def _coupling_sql(by: str) -> str:
    return f"""{WITH}, {adapters.ROLLUP_SQL}, t AS (SELECT id, coalesce(nullif({by}, ''), '(default)') AS grp, is_abstract FROM entity WHERE parent_id IS NULL AND coalesce(stereotype, '') <> 'TEST'),
l AS (SELECT DISTINCT src, dst, a.grp AS ga, b.grp AS gb FROM rolled JOIN t a ON src = a.id JOIN t b ON dst = b.id WHERE a.grp <> b.grp),
c AS (SELECT grp, count(*) AS types, count_if(is_abstract)::DOUBLE AS ab, (SELECT count(DISTINCT src) FROM l WHERE gb = grp) AS ca, (SELECT count(DISTINCT dst) FROM l WHERE ga = grp) AS ce FROM t GROUP BY grp),
r AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0::DOUBLE ELSE ce::DOUBLE / (ca + ce)::DOUBLE END AS i, ab / types::DOUBLE AS a FROM c)
SELECT grp, types, ca::BIGINT AS ca, ce::BIGINT AS ce, {round_sql("i")} AS instability, {round_sql("a")} AS abstractness, {round_sql("abs(a + i - 1)")} AS distance FROM r"""


@query(_coupling_sql("package_name"))
def package_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coupling(*both(spark, sf_dir), "package_name")


@query(_coupling_sql("module"))
def module_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coupling(*both(spark, sf_dir), "module")


@query(f"SELECT {round_sql('instability', 2)} AS x, {round_sql('abstractness', 2)} AS y, array_to_string(list_sort(list(grp)), ',') AS names, count(*) AS n FROM ({_coupling_sql('package_name')}) GROUP BY ALL")
def merged_coupling_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.kpi import merged_points

    return merged_points(metrics.coupling(*both(spark, sf_dir), "package_name"))


@query(f"""{WITH} SELECT CASE WHEN complexity >= 20 THEN '20+' WHEN complexity >= 10 THEN '10-19' WHEN complexity >= 5 THEN '5-9' WHEN complexity >= 2 THEN '2-4' ELSE '1' END AS bucket, count(*) AS n
FROM entity WHERE kind IN ('METHOD', 'CONSTRUCTOR') GROUP BY 1""")
def complexity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.complexity_buckets(adapters.entities(spark, sf_dir))


AFFECTED_SQL = f"""{WITH}, {{g}}, {MOVES_SQL}, seed AS (SELECT id FROM entity WHERE {SEED_SQL} UNION SELECT e.id FROM entity e WHERE e.parent_id IN (SELECT id FROM entity WHERE {SEED_SQL})),
r AS (SELECT id AS node, false AS flag, 0 AS d FROM seed UNION SELECT m.t, m.flag, r.d + m.cost FROM r JOIN mv m ON m.frm = r.node WHERE NOT (r.flag AND m.closed) AND r.d + m.cost <= 10),
reached AS (SELECT node, min(d)::INT AS depth, bool_and(flag) AS dispatched FROM r GROUP BY node),
affected AS (SELECT e.id, e.kind, e.module, e.package_name, coalesce(e.parent_id, e.id) AS owner_id, o.stereotype AS role, x.depth, coalesce(o.stereotype = 'TEST', false) AS test
  FROM reached x JOIN entity e ON x.node = e.id JOIN entity o ON o.id = coalesce(e.parent_id, e.id) WHERE NOT x.dispatched AND x.depth > 0 AND e.id NOT IN (SELECT id FROM seed))""".replace("{g}", "g AS (SELECT * FROM edge)")


def _affected(spark: SparkSession, sf_dir: str, tests: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    entity, edge = both(spark, sf_dir)
    seeds = impact.seeds_of_entity(entity, entity.where(SEED))
    return entity, edge, seeds, impact.affected(spark, entity, edge, seeds, tests=tests)


@query(f"{AFFECTED_SQL} SELECT * FROM affected WHERE NOT test")
def impact_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _affected(spark, sf_dir)[3]


@query(f"{AFFECTED_SQL} SELECT coalesce(role, 'OTHER') AS role, count(DISTINCT owner_id) AS owners FROM affected WHERE NOT test AND owner_id NOT IN (SELECT id FROM seed) GROUP BY 1")
def impact_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, seeds, rows = _affected(spark, sf_dir)
    return impact.by_role(rows, seeds)


@query(f"{AFFECTED_SQL} SELECT a.*, e.name FROM affected a JOIN entity e USING (id) WHERE NOT test ORDER BY a.depth, e.name, a.id LIMIT 50")
def impact_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, _, _, rows = _affected(spark, sf_dir)
    return impact.first_rows(rows, entity, 50)




@query(f"""{AFFECTED_SQL}, own AS (SELECT (SELECT coalesce(sum(complexity), 0)::BIGINT FROM entity WHERE {SEED_SQL}) AS complexity, coalesce(bool_or(e.kind = 'ENDPOINT' OR coalesce(o.stereotype, '') = 'CONTROLLER'), false) AS api
    FROM entity e LEFT JOIN entity o ON o.id = coalesce(e.parent_id, e.id) WHERE e.id IN (SELECT id FROM seed)),
facts AS (SELECT count_if(depth = 1)::BIGINT AS direct, count(*) AS total, coalesce(max(depth), 0)::BIGINT AS max_depth, count_if(kind = 'ENDPOINT')::BIGINT AS endpoints, array_to_string(list_sort(list(DISTINCT module)), ',') AS modules, count(DISTINCT package_name) AS packages FROM affected WHERE NOT test),
nt AS (SELECT count(DISTINCT owner_id) AS tests FROM affected WHERE test),
cp AS (SELECT count(*)::BIGINT AS coupling FROM (SELECT dst FROM edge WHERE src IN (SELECT id FROM seed) AND dst NOT IN (SELECT id FROM seed) UNION SELECT src FROM edge WHERE dst IN (SELECT id FROM seed) AND src NOT IN (SELECT id FROM seed))),
one AS (SELECT *, api OR endpoints > 0 AS exposed FROM facts, nt, cp, own),
s AS (SELECT *, {risk_sql(norm_sql("total", "100::BIGINT"), norm_sql("max_depth", "10::BIGINT"), norm_sql("coupling", "50::BIGINT"), norm_sql("complexity", "1000::BIGINT"), "CASE WHEN exposed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")} AS risk FROM one)
SELECT direct, total, max_depth, endpoints, modules, packages, tests, coupling, complexity, exposed, risk, CASE WHEN risk >= 60 THEN 'HIGH' WHEN risk >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level, total > 500 AS truncated FROM s""")
def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity, edge = both(spark, sf_dir)
    seeds = impact.seeds_of_entity(entity, entity.where(SEED))
    top = spark.range(1).selectExpr("100L max_dependents", "10L max_depth", "50L max_coupling", "1000L max_complexity")
    return impact.summary(spark, entity, edge, seeds, top, entity.where(SEED))


@query(f"""{WITH}, seed AS (SELECT id FROM entity WHERE {SEED_SQL} UNION SELECT e.id FROM entity e WHERE e.parent_id IN (SELECT id FROM entity WHERE {SEED_SQL})),
steps AS (SELECT DISTINCT dst AS frm, src AS t, 1 AS cost, type = 'OVERRIDES' AS closed FROM edge UNION ALL SELECT DISTINCT src, dst, 0, false FROM edge WHERE type = 'OVERRIDES'),
r AS (SELECT id AS node, false AS flag, 0 AS d, 0 AS z FROM seed UNION SELECT m.t, m.cost = 0, r.d + m.cost, CASE WHEN m.cost = 0 THEN r.z + 1 ELSE 0 END FROM r JOIN steps m ON m.frm = r.node
    WHERE NOT (r.flag AND m.closed) AND r.d + m.cost <= 10 AND r.z < 12),
best AS (SELECT node, flag, min(d * 100 + z) AS at FROM r GROUP BY ALL),
tree AS (SELECT b.node, b.flag, b.at // 100 AS depth, min((p.node, p.flag, e.type)) AS via FROM best b JOIN best p ON CASE WHEN b.at % 100 = 0 THEN p.at // 100 = b.at // 100 - 1 ELSE p.at = b.at - 1 END
    JOIN edge e ON CASE WHEN b.at % 100 = 0 THEN NOT b.flag AND e.dst = p.node AND e.src = b.node AND NOT (p.flag AND e.type = 'OVERRIDES') ELSE b.flag AND e.src = p.node AND e.dst = b.node AND e.type = 'OVERRIDES' END
    WHERE b.at > 0 GROUP BY ALL),
walk AS (SELECT node AS id, node, flag, '' AS path FROM tree WHERE NOT flag UNION ALL
    SELECT w.id, t.via[1], t.via[2], ' ' || t.via[3] || CASE WHEN w.flag THEN '! ' ELSE ' ' END || w.node || w.path FROM walk w JOIN tree t ON t.node = w.node AND t.flag = w.flag)
SELECT w.id, t.depth::INT AS depth, t.via[3] AS type, w.node || w.path AS path FROM walk w JOIN tree t ON t.node = w.id AND NOT t.flag JOIN seed s ON s.id = w.node AND NOT w.flag
    JOIN entity e ON e.id = w.id JOIN entity o ON o.id = coalesce(e.parent_id, e.id) WHERE coalesce(o.stereotype, '') <> 'TEST'""")
def impact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a change gets to each affected entity; ! marks a step by dispatch."""
    entity, edge = both(spark, sf_dir)
    rows = impact.explanations(spark, entity, edge, impact.seeds_of_entity(entity, entity.where(SEED)))
    step = lambda x: F.concat(F.lit(" "), x["type"], F.when(x["dispatch"], "! ").otherwise(" "), x["node"].cast("string"))
    path = F.concat(F.col("path")[0]["node"].cast("string"), F.array_join(F.transform(F.slice("path", 2, 1000), step), ""))
    return rows.select("id", "depth", "type", path.alias("path"))


#: The same with the maxima of the project.
SCALED_SQL = ORACLES["impact_summary"].replace("one AS (SELECT *, api", f"top AS ({MEASURED_SQL} SELECT * FROM top), one AS (SELECT *, api")
for _literal, _column in (("100::BIGINT", "max_dependents"), ("10::BIGINT", "max_depth"), ("50::BIGINT", "max_coupling"), ("1000::BIGINT", "max_complexity")):
    SCALED_SQL = SCALED_SQL.replace(f" {_literal}", f" (SELECT {_column} FROM top)").replace(f"({_literal}", f"((SELECT {_column} FROM top)")


@query(SCALED_SQL.replace(f"a.l_quantity >= {adapters.QUANTITY} AND b.l_quantity >= {adapters.QUANTITY} AND ", ""))
def impact_summary_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all lines."""
    with adapters.all_lines():
        entity, edge = both(spark, sf_dir)
    seeds = impact.seeds_of_entity(entity, entity.where(SEED))
    return impact.summary(spark, entity, edge, seeds, metrics.scale(metrics.measured(spark, entity, edge)), entity.where(SEED))


@query(f"""{MEASURED_SQL} SELECT count_if(level = 'HIGH')::BIGINT AS high, count_if(level = 'MEDIUM')::BIGINT AS medium, count_if(level = 'LOW')::BIGINT AS low, {round_sql(MEAN_RISK_SQL)} AS mean_risk, max(risk) AS max_risk,
{round_sql("avg(CASE WHEN kind IN ('METHOD', 'CONSTRUCTOR') THEN complexity END)")} AS mean_complexity, max(CASE WHEN kind IN ('METHOD', 'CONSTRUCTOR') THEN complexity END) AS max_complexity, max(depth) AS max_depth, count_if(exposed)::BIGINT AS exposed
FROM scored WHERE kind IN ('CLASS', 'INTERFACE', 'METHOD', 'CONSTRUCTOR')""")
def overview_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.operators.kpi import overview

    return overview(risks(spark, sf_dir))
