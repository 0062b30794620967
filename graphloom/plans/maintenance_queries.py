"""What is kept and changed: stored projects, the chunk index of a stream, figures kept up to date by changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import trigrams, upkeep
from graphloom.operators.store import Store
from graphloom.plans.graph_queries import WITH, both
from graphloom.plans.registry import registry
from graphloom.sources import adapters
from graphloom.streaming import projects
from graphloom.streaming.deltas import DeltaIndex
from graphloom.tables import fresh_folder, table, written

QUERIES, ORACLES, query = registry()
WHOLE = WITH.replace(f"a.l_quantity >= {adapters.QUANTITY} AND b.l_quantity >= {adapters.QUANTITY} AND ", "")


@query(f"""{WHOLE}, f AS (SELECT e.src, e.dst, e.type, e.weight, s.file_id FROM edge e JOIN entity s ON s.id = e.src)
SELECT 'entity' AS part, kind AS type, file_id::BIGINT AS file_id, count(*) AS n, sum(CASE WHEN file_id % 20 = 3 THEN complexity + 1 ELSE complexity END)::BIGINT AS total FROM entity WHERE file_id % 20 <> 7 GROUP BY ALL
UNION ALL SELECT 'edge', type, file_id, count(*), sum(CASE WHEN file_id % 20 = 3 THEN weight * 2 ELSE weight END)::BIGINT FROM f WHERE file_id % 20 <> 7 GROUP BY ALL""")
def store_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project as stored, after an edit of some files and the removal of others, by kind and file. Edges are of all lines."""
    with adapters.all_lines():
        entity, edge = both(spark, sf_dir)
    edge = edge.join(entity.select(F.col("id").alias("src"), "file_id"), "src")
    store = Store(spark, fresh_folder(spark))
    store.replace(1, entity=entity, edge=edge)
    edited, gone = (entity.where(F.col("file_id") % 20 == k).select("file_id").distinct() for k in (3, 7))
    now = lambda df, c, by: df.join(edited, "file_id", "left_semi").withColumn(c, by)
    store.patch(1, edited.unionByName(gone), entity=now(entity, "complexity", F.col("complexity") + 1), edge=now(edge, "weight", F.col("weight") * 2))
    count = lambda part, df, by, c: df.groupBy(F.lit(part).alias("part"), F.col(by).alias("type"), F.col("file_id").cast("long").alias("file_id")).agg(F.count("*").alias("n"), F.sum(c).alias("total"))
    return count("entity", store.load("entity", 1), "kind", "complexity").unionByName(count("edge", store.load("edge", 1), "type", "weight"))


def in_lots(spark: SparkSession, events: DataFrame, at: str, files: int) -> None:
    """Events in three lots of so many files; the last lot holds half of the first one again."""
    events, lot = written(spark, events), F.pmod(F.xxhash64("seq"), F.lit(3))
    for i in range(3):
        events.where((lot == i) | (F.lit(i == 2) & (lot == 0) & (F.col("seq") % 2 == 0))).repartition(files).write.mode("append").parquet(at)


@query("""WITH e AS (SELECT doc_id % 20 AS project_id, doc_id AS seq, doc_id % 97 = 0 AS gone, 'p' || (doc_id // 20) % 7 AS path, lang, source, left(sha256(coalesce(text, '')), 16) AS hash FROM documents),
d AS (SELECT project_id, max(seq) AS seq FROM e WHERE gone GROUP BY 1), l AS (SELECT e.* FROM e LEFT JOIN d USING (project_id) WHERE NOT gone AND e.seq > coalesce(d.seq, -1) QUALIFY row_number() OVER (PARTITION BY e.project_id, path ORDER BY e.seq DESC) = 1)
SELECT project_id, path, 'one' AS id, hash, lang AS text FROM l UNION ALL SELECT project_id, path, 'two', hash, source FROM l WHERE seq % 2 = 0""")
def project_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events of twenty projects, out of order and some of them twice; the index that the stream leaves."""
    k, text = F.col("doc_id"), F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(16))
    chunk = lambda id_, c: F.struct(F.lit(id_).alias("id"), text.alias("hash"), F.col(c).alias("text"))
    chunks = F.when(k % 2 == 0, F.array(chunk("one", "lang"), chunk("two", "source"))).otherwise(F.array(chunk("one", "lang")))
    gone = k % 97 == 0
    events = table(spark, sf_dir, "documents").select(
        (k % 20).alias("project_id"), k.alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000) + k % 1000).alias("at"), F.when(gone, "delete").otherwise("update").alias("kind"),
        F.when(~gone, F.concat(F.lit("p"), (F.floor(k / 20) % 7).cast("string"))).alias("path"), F.when(~gone, chunks).alias("chunks"),
    )
    at, files = fresh_folder(spark), spark.sparkContext.defaultParallelism
    in_lots(spark, events, f"{at}/events", files)
    index, provider = DeltaIndex(spark, f"{at}/index", "none"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, projects.PROVIDER)
    try:
        projects.maintain(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/events"), index, f"{at}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return index.read().select("project_id", "path", "id", "hash", "text")


EDITED_SQL = """now AS (SELECT package_name, CASE WHEN file_id % 8 = 1 AND kind = 'METHOD' THEN 'ENDPOINT' ELSE kind END AS kind, CASE WHEN file_id % 8 = 1 THEN 'TEST' ELSE stereotype END AS stereotype,
    CASE WHEN file_id % 8 = 1 THEN (complexity % 101)::DOUBLE ELSE least(complexity * 1.5::DOUBLE, 100.0::DOUBLE) END AS risk FROM entity WHERE file_id % 8 <> 2)"""


def _edited(entity: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows before an edit, those that it takes out, and those that it brings."""
    risk = F.least(F.col("complexity") * F.lit(1.5), F.lit(100.0))
    rows = entity.select("file_id", "complexity", "package_name", "kind", "stereotype", risk.alias("risk"))
    out = rows.where("file_id % 8 in (1, 2)")
    into = rows.where("file_id % 8 = 1").withColumn("kind", F.when(F.col("kind") == "METHOD", "ENDPOINT").otherwise(F.col("kind"))).withColumn("stereotype", F.lit("TEST")).withColumn("risk", (F.col("complexity") % 101).cast("double"))
    return rows, out, into


@query(f"""{WITH}, {EDITED_SQL} SELECT package_name, count_if(kind IN ('CLASS', 'INTERFACE'))::BIGINT AS types, count_if(kind = 'METHOD')::BIGINT AS methods, count_if(kind = 'ENDPOINT')::BIGINT AS endpoints, count_if(kind IN ('CLASS', 'INTERFACE') AND stereotype = 'TEST')::BIGINT AS tests,
count_if(risk >= 60)::BIGINT AS high, count_if(risk >= 30 AND risk < 60)::BIGINT AS medium, count_if(risk < 30)::BIGINT AS low, floor(sum(round(risk * 10)::BIGINT)::DOUBLE / (count(*)::DOUBLE * 10) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS avg_risk, max(risk) AS max_risk FROM now GROUP BY 1""")
def figures_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of packages after an edit, from those before it and the rows that it touches."""
    before, out, into = _edited(adapters.entities(spark, sf_dir))
    return upkeep.figures(upkeep.changed(upkeep.counted(before, "package_name"), out, into, "package_name"), "package_name")


PATTERN_SQL = "pat AS (SELECT row_number() OVER (ORDER BY q) AS query_id, q FROM (SELECT DISTINCT lower(p_brand) AS q FROM part UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT 'd#' UNION SELECT 'no such name'))"


@query(f"""{WITH}, {PATTERN_SQL}, hit AS (SELECT query_id, e.*, CASE WHEN lower(name) = q THEN 0 WHEN starts_with(lower(name), q) THEN 1 ELSE 2 END AS rank FROM pat JOIN entity e ON contains(lower(name), q) OR contains(lower(qualified_name), q))
SELECT query_id, id, name, kind, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, length(name), name, id)::INT AS place FROM hit QUALIFY place <= 20""")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search by trigrams for all brands and names, a pattern of two characters and one that nothing holds."""
    part, entity = table(spark, sf_dir, "part"), adapters.entities(spark, sf_dir)
    told = spark.createDataFrame([("d#",), ("no such name",)], "text string")
    texts = part.select(F.lower("p_brand").alias("text")).unionByName(part.select(F.lower("p_name").alias("text"))).unionByName(told).distinct()
    patterns = texts.withColumn("query_id", F.row_number().over(Window.orderBy("text")).cast("long"))  # a stated query set
    index = trigrams.Trigrams(spark, fresh_folder(spark))
    index.build(entity)
    return trigrams.ranked_all(index, entity, patterns)
