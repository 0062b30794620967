"""Names, paths and source text, on strings made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.plans.graph_queries import WITH
from graphloom.plans.registry import registry
from graphloom.sources import adapters, archives, trees
from graphloom.tables import fresh_folder, table

QUERIES, ORACLES, query = registry()
SKIP_SQL = "[" + ", ".join(f"'{w}'" for w in fn.KEYWORDS) + "]"
TYPE_SQL = "replace(p_brand, 'Brand#', 'com.acme.Brand')"
#: A type's text made of a part's columns.
TEXT_SQL = f"'@Valid(x) final java.util.Map<' || {TYPE_SQL} || ', List<? extends ' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) || '>> ' || CASE WHEN p_size % 3 = 0 THEN '[]' WHEN p_size % 3 = 1 THEN '...' ELSE '' END"


def type_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = lambda s, a, b=1000: F.substring(s, a, b)
    tail = F.when(F.col("p_size") % 3 == 0, "[]").when(F.col("p_size") % 3 == 1, "...").otherwise("")
    text = F.concat(F.lit("@Valid(x) final java.util.Map<"), F.replace("p_brand", F.lit("Brand#"), F.lit("com.acme.Brand")), F.lit(", List<? extends "), F.upper(sub("p_type", 1, 1)), F.lower(sub("p_type", 2)), F.lit(">> "), tail)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


@query(f"""SELECT p_partkey AS id, array_to_string(list_filter(regexp_extract_all(regexp_replace({TEXT_SQL}, '{fn.ANNOTATION}', '', 'g'), '{fn.NAME}'), lambda x: NOT list_contains({SKIP_SQL}, x)), ',') AS tokens FROM part""")
def type_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_texts(spark, sf_dir).select("id", F.array_join(fn.type_tokens("text"), ",").alias("tokens"))


@query(f"""WITH a AS (SELECT p_partkey AS id, regexp_replace(regexp_replace({TEXT_SQL}, '{fn.ANNOTATION}', '', 'g'), '\\s+', '', 'g') AS t FROM part),
b AS (SELECT id, regexp_replace(regexp_replace(t, '<[^<>]*>', '', 'g'), '<[^<>]*>', '', 'g') AS t FROM a)
SELECT id, regexp_replace(replace(t, '...', '[]'), '^[^\\[]*\\.', '') AS erased FROM b""")
def erased_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_texts(spark, sf_dir).select("id", fn.erased("text").alias("erased"))


QN_SQL = f"{TYPE_SQL} || CASE WHEN p_size % 4 = 0 THEN '.Inner' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '#find(Long)' WHEN p_size % 3 = 1 THEN '#<init>(Repo)' ELSE '' END"
KIND_SQL = "CASE WHEN p_size % 11 = 0 THEN 'ENDPOINT' WHEN p_size % 3 = 0 THEN 'METHOD' WHEN p_size % 3 = 1 THEN 'CONSTRUCTOR' ELSE 'CLASS' END"


def qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    qn = F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("com.acme.Brand")), F.when(size % 4 == 0, ".Inner").otherwise(""), F.when(size % 3 == 0, "#find(Long)").when(size % 3 == 1, "#<init>(Repo)").otherwise(""))
    kind = F.when(size % 11 == 0, "ENDPOINT").when(size % 3 == 0, "METHOD").when(size % 3 == 1, "CONSTRUCTOR").otherwise("CLASS")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), qn.alias("qualified_name"), kind.alias("kind"), F.col("p_name").alias("name"))


@query(f"""WITH q AS (SELECT p_partkey AS id, {QN_SQL} AS qn, {KIND_SQL} AS kind, p_name AS name FROM part), t AS (SELECT *, regexp_replace(string_split(qn, '#')[1], '^([^A-Z.][^.]*\\.)+', '') AS ty, CASE WHEN contains(qn, '#') THEN substr(qn, strpos(qn, '#') + 1) END AS member FROM q)
SELECT id, CASE WHEN kind = 'ENDPOINT' THEN name WHEN member IS NULL THEN ty WHEN starts_with(member, '<init>') THEN ty || substr(member, 7) ELSE ty || '#' || member END AS label FROM t""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualified(spark, sf_dir).select("id", fn.label("qualified_name", "kind", "name").alias("label"))


@query(f"SELECT p_partkey AS id, regexp_extract(string_split({QN_SQL}, '#')[1], '^(.*)\\.[^.]*$', 1) AS package FROM part")
def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualified(spark, sf_dir).select("id", fn.package_of("qualified_name").alias("package"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'public ' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'static final ' ELSE '' END || p_type || ' ' || p_name || '(' || p_brand || ' x)' AS signature FROM part""")
def display_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    mods = F.when(size % 3 == 0, "static,final").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fn.signature(F.lit("METHOD"), F.when(size % 2 == 0, "public").otherwise("package"), mods, "p_type", "p_name", F.concat("p_brand", F.lit(" x"))).alias("signature"))


PATH_SQL = "'m' || p_size % 4 || CASE WHEN p_size % 5 = 0 THEN '/src/test/' ELSE '/src/main/' END || replace(p_name, ' ', '/') || CASE WHEN p_size % 7 = 0 THEN 'Test' WHEN p_size % 13 = 0 THEN 'IT' ELSE '' END || CASE WHEN p_size % 9 = 0 THEN '/package-info.java' WHEN p_size % 10 = 1 THEN '.kt' ELSE '.java' END"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    path = F.concat(
        F.lit("m"), (size % 4).cast("string"), F.when(size % 5 == 0, "/src/test/").otherwise("/src/main/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(size % 7 == 0, "Test").when(size % 13 == 0, "IT").otherwise(""),
        F.when(size % 9 == 0, "/package-info.java").when(size % 10 == 1, ".kt").otherwise(".java"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))


@query(f"""WITH p AS (SELECT p_partkey AS id, {PATH_SQL} AS path FROM part) SELECT id, path, ends_with(path, '.java') AND NOT ends_with(path, 'package-info.java') AND NOT ends_with(path, 'module-info.java') AS source,
contains(path, 'src/test/') OR contains(path, '/src/integrationTest/') OR regexp_matches(path, '(Test|Tests|IT|TestCase)\\.java$') AS test FROM p""")
def file_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).select("id", "path", fn.is_source("path").alias("source"), fn.is_test("path").alias("test"))


@query(f"""WITH p AS (SELECT p_partkey AS id, {PATH_SQL} AS path FROM part) SELECT id, CASE WHEN starts_with(path, 'm1/src/main/red/') THEN 'm1/src/main/red' WHEN starts_with(path, 'm1/') THEN 'm1' WHEN starts_with(path, 'm2/') THEN 'm2' ELSE 'root' END AS module FROM p""")
def module_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds = spark.createDataFrame([("m1/pom.xml",), ("m2/build.gradle",), ("m1/src/main/red/build.gradle.kts",), ("pom.xml",)], "path string")
    return trees.modules(paths(spark, sf_dir), builds).select("id", "module")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS excerpt FROM documents WHERE text IS NOT NULL")
def source_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fn.excerpt("text", 2, 4).alias("excerpt"))


@query(f"{WITH} SELECT kind, count_if(is_abstract)::BIGINT AS abstract_types FROM entity GROUP BY 1")
def abstract_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.entities(spark, sf_dir).groupBy("kind").agg(F.count_if("is_abstract").alias("abstract_types"))


FILE_SQL = "'m' || doc_id % 4 || CASE WHEN doc_id % 5 = 0 THEN '/src/test/' ELSE '/src/main/' END || CASE WHEN doc_id % 11 = 0 THEN 'build/' ELSE '' END || 'D' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.java' END"


@query(f"""WITH f AS (SELECT {FILE_SQL} AS path, coalesce(text, '') AS text FROM documents)
SELECT path, CASE left(path, 2) WHEN 'm1' THEN 'm1' WHEN 'm2' THEN 'm2' ELSE 'root' END AS module, sha256(text) AS sha256, strlen(text)::BIGINT AS size, contains(path, 'src/test/') AS test,
len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[ \\t\\n\\f\\r\\x0B]+', '', 'g')) > 0))::BIGINT AS loc FROM f WHERE ends_with(path, '.java') AND NOT contains(path, '/build/') AND strlen(text) <= {trees.MAX_BYTES}""")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of archives, one for each task that writes, read back by ranges of entries."""
    k = F.col("doc_id")
    path = F.concat(F.lit("app/m"), (k % 4).cast("string"), F.when(k % 5 == 0, "/src/test/").otherwise("/src/main/"), F.when(k % 11 == 0, "build/").otherwise(""), F.lit("D"), k.cast("string"), F.when(k % 7 == 0, ".txt").otherwise(".java"))
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    builds = spark.createDataFrame([("app/m1/pom.xml", "x"), ("app/m2/build.gradle", "x"), ("app/pom.xml", "x")], "path string, content string")
    made = archives.packed(files.unionByName(builds), fresh_folder(spark)).collect()  # a row for each task
    return archives.scan(spark, *(r.archive for r in made), maxUnpacked=1 << 40, maxEntries=1 << 30).select("path", "module", "sha256", "size", "test", fn.lines_of_code("text").alias("loc"))
