"""Reports: facts as a variant column beside their narrative, kept by project, read back by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as fn
from graphloom.operators import graph, impact, kpi
from graphloom.schema import METHOD_KINDS, TYPE_KINDS
from graphloom.tables import written

SCHEMA = "report_id long, entity_id long, kind string, facts variant, summary string, model string, created_at timestamp, project_id long"
LATEST, TYPES, LISTED, AFFECTED, RISKIEST, ENDPOINTS, MEMBERS, NEIGHBOURS = 20, 10, 15, 25, 5, 25, 25, 12


class Reports:
    """An append-only table under a folder that driver and executors share, a folder a project. A report is one row: what was
    found and what was written about it are stored at once or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def all(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (x.split() for x in SCHEMA.split(", ")))).where("false")
        return self.spark.read.schema(SCHEMA).parquet(self.root)

    def save(self, reports: DataFrame) -> None:
        """reports: project_id, entity_id, kind, facts (JSON), summary, model, created_at. Ids go on from a project's last one, by
        creation, then entity. Facts that are no JSON raise an error; null ones stay null."""
        last = self.all().groupBy("project_id").agg(F.max("report_id").alias("last"))
        place = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "entity_id", "facts"))
        rows = reports.withColumn("place", place).join(last, "project_id", "left")
        rows = rows.select((F.coalesce("last", F.lit(0)) + F.col("place")).cast("long").alias("report_id"), "entity_id", "kind", F.parse_json("facts").alias("facts"), "summary", "model", "created_at", "project_id")
        written_ = written(self.spark, rows)  # ids are taken from the table that is about to grow
        written_.repartition("project_id").write.mode("append").partitionBy("project_id").parquet(self.root)

    def latest(self, n: int = LATEST) -> DataFrame:
        """The latest n reports of each project, with their place."""
        return kpi.latest_reports(self.all(), n)

    def get(self, project: int, report: int) -> DataFrame:
        """One report, if that project has it."""
        return self.all().where((F.col("project_id") == project) & (F.col("report_id") == report))


def field(path: str, kind: str = "string") -> Column:
    """What the facts hold at a path as `$.target.label`, null where there is nothing of that kind."""
    return F.try_variant_get("facts", path, kind)


def _labelled(entity: DataFrame, id_: str = "id", label: str = "label") -> DataFrame:
    """Joined by shuffle: files of names are small beside the labels made of them."""
    return entity.select(F.col("id").alias(id_), fn.label("qualified_name", "kind", "name").alias(label)).hint("merge")


def _first(rows: DataFrame, n: int, value: Column, *order: str) -> DataFrame:
    """One row, list: the first n values by order."""
    top = rows.orderBy(*order).limit(n).select(F.struct(*order, value.alias("value_")).alias("x"))
    return top.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["value_"]).alias("list"))


def path_text(spark: SparkSession, entity: DataFrame, paths: DataFrame) -> DataFrame:
    """id, text: a path (id, path of node, type, dispatch) as labels with what leads to each: `A <-calls- B <-dispatch- C`."""
    steps = paths.select("id", F.posexplode("path").alias("at", "step")).select("id", "at", F.col("step.node").alias("node"), "step.type", "step.dispatch")
    edge = F.when(F.col("dispatch"), F.lit("dispatch")).otherwise(F.lower("type"))
    part = F.when(F.col("at") == 0, F.col("node_label")).otherwise(F.concat(F.lit(" <-"), edge, F.lit("- "), F.col("node_label")))
    steps = steps.join(_labelled(entity, "node", "node_label"), "node").select("id", F.struct("at", part.alias("part")).alias("x"))
    return steps.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("text"))


def impact_facts(spark: SparkSession, entity: DataFrame, edge: DataFrame, targets: DataFrame, top: DataFrame, max_depth: int = impact.MAX_DEPTH) -> DataFrame:
    """One row, facts: the impact of a change to the targets (id) as JSON, of a size that suits a prompt: the target, figures of
    `impact.summary`, the first endpoints and tests, types by role, and the nearest affected entities with the path to each.
    Lists are by depth, then name and id, or by label."""
    edge = written(spark, edge)
    seeds = written(spark, impact.seeds_of_entity(entity, targets))
    rows = written(spark, impact.affected(spark, entity, edge, seeds, max_depth, tests=True).join(entity.select("id", "name"), "id").join(_labelled(entity), "id"))
    real = rows.where("not test")
    near = written(spark, real.orderBy("depth", "name", "id").limit(AFFECTED))
    how = impact.explanations(spark, entity, edge, seeds, max_depth).join(near.select("id"), "id", "left_semi")
    how = how.select("id", "type", "path").join(path_text(spark, entity, how), "id")
    named = near.join(how, "id").withColumn("via", F.col("type"))
    nearest = _first(named, AFFECTED, F.struct(F.col("label").alias("entity"), "depth", "via", F.col("text").alias("path")), "depth", "name", "id").withColumnRenamed("list", "affected")
    types = rows.where("not test and owner_id is not null").join(seeds.select(F.col("id").alias("owner_id")), "owner_id", "left_anti")
    types = types.select(F.coalesce("role", F.lit("OTHER")).alias("role"), "owner_id").distinct().join(_labelled(entity, "owner_id", "owner"), "owner_id")
    types = types.withColumn("n_", F.row_number().over(Window.partitionBy("role").orderBy("owner", "owner_id"))).where(F.col("n_") <= TYPES)
    types = types.groupBy("role").agg(F.array_sort(F.collect_list("owner")).alias("labels")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "labels")))).alias("affectedTypes"))
    tests = rows.where("test").select("owner_id").distinct().join(_labelled(entity, "owner_id", "owner"), "owner_id")
    one = impact.summary(spark, entity, edge, seeds, top, targets, max_depth)
    target = entity.join(targets.select("id"), "id", "left_semi").join(_labelled(entity), "id")
    target = target.agg(F.min_by(F.struct("label", F.col("qualified_name").alias("qualifiedName"), "kind", F.col("stereotype").alias("role")), "id").alias("target"))
    for more in (target, _first(real.where("kind = 'ENDPOINT'"), LISTED, F.col("label"), "depth", "name", "id").withColumnRenamed("list", "affectedEndpoints"), types, _first(tests, LISTED, F.col("owner"), "owner", "owner_id").withColumnRenamed("list", "testsToRun"), nearest):
        one = one.join(more, how="cross")  # rows of one
    return one.select(F.to_json(F.struct(
        "target", F.struct(F.col("risk").alias("score"), "level").alias("risk"), F.col("direct").alias("directDependents"), F.col("total").alias("transitiveDependents"), F.col("max_depth").alias("maxDepth"),
        "affectedEndpoints", "affectedTypes", F.filter(F.split("modules", ","), lambda m: m != "").alias("modules"), "testsToRun", "affected", "truncated",
    )).alias("facts"))


def project_facts(entity: DataFrame, scored: DataFrame, cycles: DataFrame, by: str = "project_id") -> DataFrame:
    """project, facts of each project: counts of its entities, roles of its types, the riskiest (label, risk, dependents), the
    first endpoints with their handlers, and how many dependency cycles it has, as JSON. entity, cycles have the column `by`
    (cycles: a row for each member, cycle); scored: id, risk, dependents."""
    is_type, method = F.col("kind").isin(*TYPE_KINDS), F.col("kind").isin(*METHOD_KINDS)
    stats = entity.groupBy(by).agg(
        F.struct(F.count_if(is_type).alias("types"), F.count_if(method).alias("methods"), F.count_if(F.col("kind") == "ENDPOINT").alias("endpoints"), F.count_if(is_type & F.coalesce(F.col("stereotype") == "TEST", F.lit(False))).alias("tests"), F.count_distinct("file_id").alias("files")).alias("stats")
    )
    roles = entity.where(is_type).groupBy(by, F.coalesce("stereotype", F.lit("OTHER")).alias("role")).agg(F.count("*").alias("n"))
    roles = roles.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))

    def firsts(rows: DataFrame, n: int, text: Column, name: str, *order: Column) -> DataFrame:
        rows = rows.withColumn("n_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n_") <= n)
        return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_", text.alias("text")))), lambda x: x["text"]).alias(name))

    risky = entity.where(is_type | method).join(scored.select("id", "risk", "dependents").hint("merge"), "id").join(_labelled(entity), "id")
    said = F.concat("label", F.lit(" (risk "), F.floor(F.col("risk") + 0.5).cast("string"), F.lit(", "), F.col("dependents").cast("string"), F.lit(" dependents)"))
    handler = F.concat("name", F.lit(" -> "), F.regexp_replace("qualified_name", "^[^@]*@", ""))
    out = stats.join(roles, by, "left").join(firsts(risky, RISKIEST, said, "riskiest", F.desc("risk"), F.col("id")), by, "left")
    out = out.join(firsts(entity.where("kind = 'ENDPOINT'"), ENDPOINTS, handler, "ends", F.col("id")), by, "left").join(cycles.groupBy(by).agg(F.count_distinct("cycle").alias("cycles")), by, "left")
    facts = F.struct("stats", "roles", "riskiest", F.col("ends").alias("endpoints"), F.coalesce("cycles", F.lit(0)).alias("dependencyCycles"))
    return out.select(F.col(by).alias("project"), F.to_json(facts).alias("facts"))


def entity_facts(entity: DataFrame, measured: DataFrame, edge: DataFrame) -> DataFrame:
    """id, facts of every entity at once: name, kind, role, file, module, metrics, what depends on it and what it depends on
    (label and kind of edge, sorted, the first and how many more), and the members of a type, as JSON."""
    labels = _labelled(entity)

    def near(frm: str, to: str, name: str) -> DataFrame:
        rows = edge.select(F.col(frm).alias("of"), F.col(to).alias("id"), "type").join(labels, "id")
        rows = rows.select("of", F.concat("label", F.lit(" ("), F.replace(F.lower("type"), F.lit("_"), F.lit(" ")), F.lit(")")).alias("text")).distinct()
        # the first of each are kept within tasks: a hub's neighbours are never in one list
        place = F.row_number().over(Window.partitionBy("of").orderBy("text"))
        size = rows.groupBy("of").agg(F.count("*").alias("n"))
        first = rows.withColumn("n_", place).where(F.col("n_") <= NEIGHBOURS).groupBy("of").agg(F.array_sort(F.collect_list("text")).alias("first")).join(size, "of")
        more = F.when(F.col("n") > NEIGHBOURS, F.array(F.concat(F.lit("... and "), (F.col("n") - NEIGHBOURS).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
        return first.select(F.col("of").alias("id"), F.concat("first", more).alias(name))

    inside = entity.where("parent_id is not null and kind <> 'FIELD'").select("parent_id", "id").join(labels, "id")
    inside = inside.withColumn("n_", F.row_number().over(Window.partitionBy("parent_id").orderBy("id"))).where(F.col("n_") <= MEMBERS)
    inside = inside.groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_", "label"))), lambda x: x["label"]).alias("members"))
    rows = entity.select("id", "qualified_name", "kind", "stereotype", "file_id", "module", "parent_id").join(measured.drop("kind"), "id", "left").join(near("dst", "src", "dependents_"), "id", "left").join(near("src", "dst", "dependencies_"), "id", "left").join(inside, "id", "left")
    roles = entity.select(F.col("id").alias("owner_id"), F.col("stereotype").alias("owner_role"))
    rows = rows.join(graph.owners(entity), "id", "left").join(roles, "owner_id", "left")
    numbers = F.struct(*(F.col(c).alias(n) for c, n in (("fan_in", "fanIn"), ("fan_out", "fanOut"), ("dependents", "transitiveDependents"), ("dependencies", "transitiveDependencies"), ("depth", "depth"), ("complexity", "complexity"), ("risk", "riskScore"))))
    none = F.array().cast("array<string>")
    facts = F.struct(
        F.col("qualified_name").alias("qualifiedName"), "kind", F.coalesce("owner_role", "stereotype").alias("role"), F.col("file_id").alias("file"), "module", F.when(F.col("fan_in").isNotNull(), numbers).alias("metrics"),
        F.coalesce("dependents_", none).alias("dependents"), F.coalesce("dependencies_", none).alias("dependencies"), F.when(F.col("kind").isin(*TYPE_KINDS), F.coalesce("members", none)).alias("members"),
    )
    return rows.select("id", F.to_json(facts).alias("facts"))
