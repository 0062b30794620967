"""Source code to graph: a small project in as many copies as there are regions, read, resolved and kept up to date.

What the SQL states as values was worked out from the sources in `java_samples` by hand; r{r} stands for the number of a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analysis, retrieval
from graphloom.plans.registry import registry
from graphloom.sources import java_samples, trees
from graphloom.tables import fresh_folder, table, written

QUERIES, ORACLES, query = registry()
_known: dict[tuple[str, str], tuple[analysis.Project, analysis.Project, dict[str, int]]] = {}

ENTITIES = """
('endpoint:GET /orders/{id}@r{r}.api.Orders#get(Long)', 'GET /orders/{id}', 'ENDPOINT', 'r{r}.api.Orders', NULL, 'GET', '/orders/{id}', 1, false, NULL, NULL, 'GET /orders/{id}'),
('endpoint:POST /orders@r{r}.api.Orders#add(Order)', 'POST /orders', 'ENDPOINT', 'r{r}.api.Orders', NULL, 'POST', '/orders', 1, false, NULL, NULL, 'POST /orders'),
('r{r}.api.Orders', 'Orders', 'CLASS', NULL, 'CONTROLLER', NULL, NULL, 3, false, 5, 10, 'public class Orders'),
('r{r}.api.Orders#<init>(Store)', 'Orders', 'CONSTRUCTOR', 'r{r}.api.Orders', NULL, NULL, NULL, 1, false, 7, 7, 'public Orders(Store)'),
('r{r}.api.Orders#add(Order)', 'add', 'METHOD', 'r{r}.api.Orders', NULL, NULL, NULL, 1, false, 9, 9, 'public Order add(Order)'),
('r{r}.api.Orders#get(Long)', 'get', 'METHOD', 'r{r}.api.Orders', NULL, NULL, NULL, 1, false, 8, 8, 'public Order get(Long)'),
('r{r}.api.Orders#store', 'store', 'FIELD', 'r{r}.api.Orders', NULL, NULL, NULL, 1, false, 6, 6, 'private final Store store'),
('r{r}.domain.Box', 'Box', 'CLASS', NULL, NULL, NULL, NULL, 2, false, 1, 1, 'public class Box'),
('r{r}.domain.Box#first()', 'first', 'METHOD', 'r{r}.domain.Box', NULL, NULL, NULL, 1, false, 1, 1, 'public Order first()'),
('r{r}.domain.Box#put(Order)', 'put', 'METHOD', 'r{r}.domain.Box', NULL, NULL, NULL, 1, false, 1, 1, 'void put(Order)'),
('r{r}.domain.Box#top', 'top', 'FIELD', 'r{r}.domain.Box', NULL, NULL, NULL, 1, false, 1, 1, 'private Order top'),
('r{r}.domain.Order', 'Order', 'RECORD', NULL, 'ENTITY', NULL, NULL, 2, false, 1, 1, 'public record Order'),
('r{r}.domain.Order#copy()', 'copy', 'METHOD', 'r{r}.domain.Order', NULL, NULL, NULL, 1, false, 1, 1, 'public Order copy()'),
('r{r}.domain.Order#name', 'name', 'FIELD', 'r{r}.domain.Order', NULL, NULL, NULL, 1, false, 1, 1, 'private final String name'),
('r{r}.domain.Order#name()', 'name', 'METHOD', 'r{r}.domain.Order', NULL, NULL, NULL, 1, false, 1, 1, 'public String name()'),
('r{r}.domain.Rows', 'Rows', 'INTERFACE', NULL, 'REPOSITORY', NULL, NULL, 1, true, 1, 1, 'interface Rows'),
('r{r}.domain.Rows.Way', 'Way', 'ENUM', 'r{r}.domain.Rows', NULL, NULL, NULL, 1, false, 1, 1, 'enum Way'),
('r{r}.domain.Rows.Way#back()', 'back', 'METHOD', 'r{r}.domain.Rows.Way', NULL, NULL, NULL, 1, false, 1, 1, 'Way back()'),
('r{r}.order.Base', 'Base', 'INTERFACE', NULL, NULL, NULL, NULL, 1, true, 1, 1, 'public interface Base'),
('r{r}.order.Base#log(T)', 'log', 'METHOD', 'r{r}.order.Base', NULL, NULL, NULL, 1, false, 1, 1, 'public default void log(T)'),
('r{r}.order.Checks', 'Checks', 'CLASS', NULL, NULL, NULL, NULL, 2, false, 1, 1, 'final class Checks'),
('r{r}.order.Checks#check(Object)', 'check', 'METHOD', 'r{r}.order.Checks', NULL, NULL, NULL, 2, false, 1, 1, 'static void check(Object)'),
('r{r}.order.Stable', 'Stable', 'ANNOTATION', NULL, NULL, NULL, NULL, 1, true, 1, 1, 'annotation Stable'),
('r{r}.order.Store', 'Store', 'INTERFACE', NULL, NULL, NULL, NULL, 2, true, 3, 3, 'public interface Store'),
('r{r}.order.Store#load(Long)', 'load', 'METHOD', 'r{r}.order.Store', NULL, NULL, NULL, 1, true, 3, 3, 'public abstract Order load(Long)'),
('r{r}.order.Store#save(Order,int[])', 'save', 'METHOD', 'r{r}.order.Store', NULL, NULL, NULL, 1, true, 3, 3, 'public abstract Box save(Order, int[])'),
('r{r}.order.StoreImpl', 'StoreImpl', 'CLASS', NULL, 'SERVICE', NULL, NULL, 9, false, 5, 13, 'class StoreImpl'),
('r{r}.order.StoreImpl#box', 'box', 'FIELD', 'r{r}.order.StoreImpl', NULL, NULL, NULL, 1, false, 6, 6, 'private Box box'),
('r{r}.order.StoreImpl#load(Long)', 'load', 'METHOD', 'r{r}.order.StoreImpl', NULL, NULL, NULL, 3, false, 8, 8, 'public Order load(Long)'),
('r{r}.order.StoreImpl#log(Order)', 'log', 'METHOD', 'r{r}.order.StoreImpl', NULL, NULL, NULL, 3, false, 10, 10, 'public void log(Order)'),
('r{r}.order.StoreImpl#save(Order,int[])', 'save', 'METHOD', 'r{r}.order.StoreImpl', NULL, NULL, NULL, 1, false, 9, 9, 'public Box save(Order, int[])'),
('r{r}.order.StoreImpl#size()', 'size', 'METHOD', 'r{r}.order.StoreImpl', NULL, NULL, NULL, 2, false, 11, 11, 'private int size()'),
('r{r}.order.StoreImpl.Memo', 'Memo', 'CLASS', 'r{r}.order.StoreImpl', NULL, NULL, NULL, 1, false, 12, 12, 'static class Memo'),
('r{r}.order.StoreImpl.Memo#last()', 'last', 'METHOD', 'r{r}.order.StoreImpl.Memo', NULL, NULL, NULL, 1, false, 12, 12, 'Order last()'),
('r{r}.order.StoreTest', 'StoreTest', 'CLASS', NULL, 'TEST', NULL, NULL, 1, false, 1, 1, 'class StoreTest'),
('r{r}.order.StoreTest#s', 's', 'FIELD', 'r{r}.order.StoreTest', NULL, NULL, NULL, 1, false, 1, 1, 'Store s'),
('r{r}.order.StoreTest#works()', 'works', 'METHOD', 'r{r}.order.StoreTest', NULL, NULL, NULL, 1, false, 1, 1, 'void works()')
"""
EDGES = """
('endpoint:GET /orders/{id}@r{r}.api.Orders#get(Long)', 'r{r}.api.Orders#get(Long)', 'ROUTES_TO', 1),
('endpoint:POST /orders@r{r}.api.Orders#add(Order)', 'r{r}.api.Orders#add(Order)', 'ROUTES_TO', 1),
('r{r}.api.Orders', 'r{r}.domain.Order', 'IMPORTS', 1),
('r{r}.api.Orders', 'r{r}.order.Store', 'IMPORTS', 1),
('r{r}.api.Orders#<init>(Store)', 'r{r}.order.Store', 'USES_TYPE', 1),
('r{r}.api.Orders#add(Order)', 'r{r}.domain.Box#first()', 'CALLS', 1),
('r{r}.api.Orders#add(Order)', 'r{r}.domain.Order', 'USES_TYPE', 2),
('r{r}.api.Orders#add(Order)', 'r{r}.order.Store#save(Order,int[])', 'CALLS', 1),
('r{r}.api.Orders#get(Long)', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.api.Orders#get(Long)', 'r{r}.order.Store#load(Long)', 'CALLS', 1),
('r{r}.api.Orders#store', 'r{r}.order.Store', 'USES_TYPE', 1),
('r{r}.domain.Box#first()', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.domain.Box#put(Order)', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.domain.Box#top', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.domain.Order#copy()', 'r{r}.domain.Order', 'CREATES', 1),
('r{r}.domain.Order#copy()', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.domain.Rows', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.domain.Rows.Way#back()', 'r{r}.domain.Rows.Way', 'USES_TYPE', 1),
('r{r}.order.Checks#check(Object)', 'r{r}.order.Stable', 'ANNOTATED_BY', 1),
('r{r}.order.Store', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.order.Store', 'r{r}.order.Base', 'EXTENDS', 1),
('r{r}.order.Store#load(Long)', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.order.Store#save(Order,int[])', 'r{r}.domain.Box', 'USES_TYPE', 1),
('r{r}.order.Store#save(Order,int[])', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.order.StoreImpl', 'r{r}.domain.Box', 'IMPORTS', 1),
('r{r}.order.StoreImpl', 'r{r}.domain.Order', 'IMPORTS', 1),
('r{r}.order.StoreImpl', 'r{r}.order.Checks', 'IMPORTS', 1),
('r{r}.order.StoreImpl', 'r{r}.order.Store', 'IMPLEMENTS', 1),
('r{r}.order.StoreImpl#box', 'r{r}.domain.Box', 'USES_TYPE', 1),
('r{r}.order.StoreImpl#load(Long)', 'r{r}.domain.Box#first()', 'CALLS', 1),
('r{r}.order.StoreImpl#load(Long)', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.order.StoreImpl#load(Long)', 'r{r}.domain.Order#copy()', 'CALLS', 1),
('r{r}.order.StoreImpl#load(Long)', 'r{r}.order.Checks#check(Object)', 'CALLS', 1),
('r{r}.order.StoreImpl#load(Long)', 'r{r}.order.Store#load(Long)', 'OVERRIDES', 1),
('r{r}.order.StoreImpl#log(Order)', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.order.StoreImpl#log(Order)', 'r{r}.order.Base#log(T)', 'OVERRIDES', 1),
('r{r}.order.StoreImpl#log(Order)', 'r{r}.order.StoreImpl#size()', 'CALLS', 1),
('r{r}.order.StoreImpl#save(Order,int[])', 'r{r}.domain.Box', 'USES_TYPE', 1),
('r{r}.order.StoreImpl#save(Order,int[])', 'r{r}.domain.Box#put(Order)', 'CALLS', 1),
('r{r}.order.StoreImpl#save(Order,int[])', 'r{r}.domain.Order', 'CREATES', 1),
('r{r}.order.StoreImpl#save(Order,int[])', 'r{r}.domain.Order', 'USES_TYPE', 2),
('r{r}.order.StoreImpl#save(Order,int[])', 'r{r}.domain.Order#name()', 'CALLS', 1),
('r{r}.order.StoreImpl#save(Order,int[])', 'r{r}.order.Store#save(Order,int[])', 'OVERRIDES', 1),
('r{r}.order.StoreImpl#save(Order,int[])', 'r{r}.order.StoreImpl#log(Order)', 'CALLS', 1),
('r{r}.order.StoreImpl.Memo', 'r{r}.domain.Box', 'EXTENDS', 1),
('r{r}.order.StoreImpl.Memo#last()', 'r{r}.domain.Box#first()', 'CALLS', 1),
('r{r}.order.StoreImpl.Memo#last()', 'r{r}.domain.Order', 'USES_TYPE', 1),
('r{r}.order.StoreTest#s', 'r{r}.order.Store', 'USES_TYPE', 1),
('r{r}.order.StoreTest#works()', 'r{r}.order.Store#load(Long)', 'CALLS', 1)
"""
CALLS = """
('r{r}.api.Orders#add(Order)', 'first', 'call save/1 store', 0),
('r{r}.api.Orders#add(Order)', 'save', 'store', 1),
('r{r}.api.Orders#get(Long)', 'load', 'store', 1),
('r{r}.order.StoreImpl#load(Long)', 'check', NULL, 1),
('r{r}.order.StoreImpl#load(Long)', 'copy', 'call first/0 box', 0),
('r{r}.order.StoreImpl#load(Long)', 'first', 'box', 0),
('r{r}.order.StoreImpl#log(Order)', 'size', NULL, 0),
('r{r}.order.StoreImpl#save(Order,int[])', 'log', NULL, 1),
('r{r}.order.StoreImpl#save(Order,int[])', 'name', 'o', 0),
('r{r}.order.StoreImpl#save(Order,int[])', 'put', 'this.box', 1),
('r{r}.order.StoreImpl.Memo#last()', 'first', 'super', 0),
('r{r}.order.StoreTest#works()', 'load', 's', 1)
"""
FACTS = """
('src/main/java/r{r}/api/Orders.java', 'call', 3),
('src/main/java/r{r}/api/Orders.java', 'field', 1),
('src/main/java/r{r}/api/Orders.java', 'file', 1),
('src/main/java/r{r}/api/Orders.java', 'import', 2),
('src/main/java/r{r}/api/Orders.java', 'method', 3),
('src/main/java/r{r}/api/Orders.java', 'package', 1),
('src/main/java/r{r}/api/Orders.java', 'param', 3),
('src/main/java/r{r}/api/Orders.java', 'type', 1),
('src/main/java/r{r}/domain/Box.java', 'field', 1),
('src/main/java/r{r}/domain/Box.java', 'file', 1),
('src/main/java/r{r}/domain/Box.java', 'method', 2),
('src/main/java/r{r}/domain/Box.java', 'package', 1),
('src/main/java/r{r}/domain/Box.java', 'param', 1),
('src/main/java/r{r}/domain/Box.java', 'type', 1),
('src/main/java/r{r}/domain/Order.java', 'field', 1),
('src/main/java/r{r}/domain/Order.java', 'file', 1),
('src/main/java/r{r}/domain/Order.java', 'method', 2),
('src/main/java/r{r}/domain/Order.java', 'new', 1),
('src/main/java/r{r}/domain/Order.java', 'package', 1),
('src/main/java/r{r}/domain/Order.java', 'type', 1),
('src/main/java/r{r}/domain/Rows.java', 'file', 1),
('src/main/java/r{r}/domain/Rows.java', 'method', 1),
('src/main/java/r{r}/domain/Rows.java', 'package', 1),
('src/main/java/r{r}/domain/Rows.java', 'type', 2),
('src/main/java/r{r}/order/Base.java', 'file', 1),
('src/main/java/r{r}/order/Base.java', 'method', 1),
('src/main/java/r{r}/order/Base.java', 'package', 1),
('src/main/java/r{r}/order/Base.java', 'param', 1),
('src/main/java/r{r}/order/Base.java', 'type', 1),
('src/main/java/r{r}/order/Base.java', 'typeparam', 1),
('src/main/java/r{r}/order/Checks.java', 'file', 1),
('src/main/java/r{r}/order/Checks.java', 'method', 1),
('src/main/java/r{r}/order/Checks.java', 'package', 1),
('src/main/java/r{r}/order/Checks.java', 'param', 1),
('src/main/java/r{r}/order/Checks.java', 'type', 1),
('src/main/java/r{r}/order/Stable.java', 'file', 1),
('src/main/java/r{r}/order/Stable.java', 'package', 1),
('src/main/java/r{r}/order/Stable.java', 'type', 1),
('src/main/java/r{r}/order/Store.java', 'file', 1),
('src/main/java/r{r}/order/Store.java', 'import', 1),
('src/main/java/r{r}/order/Store.java', 'method', 2),
('src/main/java/r{r}/order/Store.java', 'package', 1),
('src/main/java/r{r}/order/Store.java', 'param', 3),
('src/main/java/r{r}/order/Store.java', 'type', 1),
('src/main/java/r{r}/order/StoreImpl.java', 'call', 8),
('src/main/java/r{r}/order/StoreImpl.java', 'field', 1),
('src/main/java/r{r}/order/StoreImpl.java', 'file', 1),
('src/main/java/r{r}/order/StoreImpl.java', 'import', 3),
('src/main/java/r{r}/order/StoreImpl.java', 'local', 1),
('src/main/java/r{r}/order/StoreImpl.java', 'method', 5),
('src/main/java/r{r}/order/StoreImpl.java', 'new', 1),
('src/main/java/r{r}/order/StoreImpl.java', 'package', 1),
('src/main/java/r{r}/order/StoreImpl.java', 'param', 4),
('src/main/java/r{r}/order/StoreImpl.java', 'type', 2),
('src/test/java/r{r}/order/StoreTest.java', 'call', 1),
('src/test/java/r{r}/order/StoreTest.java', 'field', 1),
('src/test/java/r{r}/order/StoreTest.java', 'file', 1),
('src/test/java/r{r}/order/StoreTest.java', 'method', 1),
('src/test/java/r{r}/order/StoreTest.java', 'package', 1),
('src/test/java/r{r}/order/StoreTest.java', 'type', 1)
"""
#: What the edit takes away and brings.
GONE = "'r{r}.order.StoreTest', 'r{r}.order.StoreTest#s', 'r{r}.order.StoreTest#works()'"
ENTITIES_MORE = """
('r{r}.domain.Box#size()', 'size', 'METHOD', 'r{r}.domain.Box', NULL, NULL, NULL, 1, false, 1, 1, 'int size()'),
('r{r}.domain.Crate', 'Crate', 'CLASS', NULL, NULL, NULL, NULL, 1, false, 1, 1, 'public class Crate'),
('r{r}.domain.Crate#inner()', 'inner', 'METHOD', 'r{r}.domain.Crate', NULL, NULL, NULL, 1, false, 1, 1, 'Box inner()')
"""
EDGES_MORE = """
('r{r}.domain.Crate', 'r{r}.domain.Box', 'EXTENDS', 1),
('r{r}.domain.Crate#inner()', 'r{r}.domain.Box', 'CREATES', 1),
('r{r}.domain.Crate#inner()', 'r{r}.domain.Box', 'USES_TYPE', 1)
"""
ENTITY_COLUMNS = ("qualified_name", "name", "kind", "parent", "stereotype", "http_method", "http_path", "complexity", "is_abstract", "start_line", "end_line", "signature")


def filled(columns: tuple[str, ...], named: tuple[str, ...]) -> str:
    """A select list in which {r} has become a copy's number in the columns that hold names."""
    return ", ".join(f"replace({c}, '{{r}}', r_regionkey::VARCHAR) AS {c}" if c in named else c for c in columns)


def projects(spark: SparkSession, sf_dir: str) -> tuple[analysis.Project, analysis.Project, dict[str, int]]:
    """The project in full, after an edit by an incremental run, and that run's counts; made once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        numbers = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n"))
        before = analysis.full(spark, java_samples.files(spark, numbers))
        _known[key] = (before, *analysis.incremental_run(spark, before, java_samples.files(spark, numbers, java_samples.SHOP | java_samples.EDITED)))
    return _known[key]


def named_entities(project: analysis.Project) -> DataFrame:
    parent = project.entity.select(F.col("id").alias("parent_id"), F.col("qualified_name").alias("parent"))
    return project.entity.drop("parent").join(parent, "parent_id", "left").select(*ENTITY_COLUMNS)


def named_edges(project: analysis.Project) -> DataFrame:
    name = lambda c: project.entity.select(F.col("id").alias(c), F.col("qualified_name").alias(f"{c}_name"))
    return project.edge.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "type", "weight")


@query(f"SELECT {filled(('path', 'what', 'n'), ('path',))} FROM (VALUES {FACTS}) v(path, what, n), region")
def java_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file states, by kind."""
    return projects(spark, sf_dir)[0].facts.groupBy("path", "what").agg(F.count("*").cast("int").alias("n"))


@query(f"SELECT {filled(('member', 'name', 'scope', 'args'), ('member',))} FROM (VALUES {CALLS}) v(member, name, scope, args), region")
def java_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as they stand, with what stands before the dot."""
    return projects(spark, sf_dir)[0].facts.where("what = 'call'").select("member", "name", "scope", "args").distinct()


@query(f"SELECT {filled(ENTITY_COLUMNS, ('qualified_name', 'parent'))} FROM (VALUES {ENTITIES}) v({', '.join(ENTITY_COLUMNS)}), region")
def java_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_entities(projects(spark, sf_dir)[0])


@query(f"SELECT {filled(('src', 'dst', 'type'), ('src', 'dst'))}, weight::BIGINT AS weight FROM (VALUES {EDGES}) v(src, dst, type, weight), region")
def java_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_edges(projects(spark, sf_dir)[0])


@query(f"""WITH e AS (SELECT * FROM (VALUES {ENTITIES.strip()}, {ENTITIES_MORE.strip()}) v({', '.join(ENTITY_COLUMNS)}) WHERE qualified_name NOT IN ({GONE})),
now AS (SELECT * REPLACE (CASE qualified_name WHEN 'r{{r}}.domain.Box' THEN 4 WHEN 'r{{r}}.domain.Box#put(Order)' THEN 2 ELSE complexity END AS complexity) FROM e)
SELECT {filled(ENTITY_COLUMNS, ('qualified_name', 'parent'))} FROM now, region""")
def java_incremental_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities after an incremental run."""
    return named_entities(projects(spark, sf_dir)[1])


@query(f"""SELECT {filled(('src', 'dst', 'type'), ('src', 'dst'))}, weight::BIGINT AS weight FROM (VALUES {EDGES.strip()}, {EDGES_MORE.strip()}) v(src, dst, type, weight), region
WHERE src NOT IN ({GONE})""")
def java_incremental_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after an incremental run: those of dependent files are resolved again."""
    return named_edges(projects(spark, sf_dir)[1])


@query("SELECT why, (n * (SELECT count(*) FROM region))::BIGINT AS n FROM (VALUES ('added', 1), ('changed', 1), ('deleted', 1), ('dependent', 3), ('waiting', 0)) v(why, n)")
def java_incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by what the incremental run did with them."""
    return spark.createDataFrame(list(projects(spark, sf_dir)[2].items()), "why string, n long")


@query("SELECT 0::BIGINT AS entities, 0::BIGINT AS edges FROM region LIMIT 1")
def java_incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the incremental run differs from a full one."""
    numbers = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n"))
    full, patched = analysis.full(spark, java_samples.files(spark, numbers, java_samples.SHOP | java_samples.EDITED)), projects(spark, sf_dir)[1]
    differ = lambda a, b: a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*"))
    entities, edges = (differ(f(full), f(patched)).withColumnRenamed("count(1)", n) for f, n in ((named_entities, "entities"), (named_edges, "edges")))
    return written(spark, entities.join(edges, how="cross"))  # rows of one


OUTLINES = """
('r{r}.api.Orders', '@RestController\n@RequestMapping\npublic class Orders {\n    private final Store store;\n    public Orders(Store) { ... }\n    @GetMapping public Order get(Long) { ... }\n    @PostMapping public Order add(Order) { ... }\n}'),
('r{r}.domain.Box', 'public class Box {\n    public Order first() { ... }\n    void put(Order) { ... }\n    private Order top;\n}'),
('r{r}.domain.Order', '@Entity\npublic record Order {\n    public Order copy() { ... }\n    private final String name;\n    public String name() { ... }\n}'),
('r{r}.domain.Rows', 'interface Rows {\n}'),
('r{r}.domain.Rows.Way', 'enum Way {\n    Way back() { ... }\n}'),
('r{r}.order.Base', 'public interface Base {\n    public default void log(T) { ... }\n}'),
('r{r}.order.Checks', 'final class Checks {\n    @Stable static void check(Object) { ... }\n}'),
('r{r}.order.Stable', 'annotation Stable {\n}'),
('r{r}.order.Store', 'public interface Store {\n    public abstract Order load(Long) { ... }\n    public abstract Box save(Order, int[]) { ... }\n}'),
('r{r}.order.StoreImpl', '@Service\nclass StoreImpl {\n    private Box box;\n    @Override public Order load(Long) { ... }\n    public Box save(Order, int[]) { ... }\n    public void log(Order) { ... }\n    private int size() { ... }\n}'),
('r{r}.order.StoreImpl.Memo', 'static class Memo {\n    Order last() { ... }\n}'),
('r{r}.order.StoreTest', 'class StoreTest {\n    Store s;\n    @Test void works() { ... }\n}')
""".replace("\\n", "\n")


@query(f"SELECT replace(qualified_name, '{{r}}', r_regionkey::VARCHAR) AS qualified_name, '// ' || replace(qualified_name, '{{r}}', r_regionkey::VARCHAR) || chr(10) || text AS text FROM (VALUES {OUTLINES}) v(qualified_name, text), region")
def java_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds of types."""
    entity = projects(spark, sf_dir)[0].entity
    return retrieval.outlines(entity).join(entity.select("id", "qualified_name"), "id").select("qualified_name", "text")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SOURCES = ", ".join(f"({quoted(path)}, {quoted(text)})" for path, text in java_samples.SHOP.items())


@query(f"""WITH e AS (SELECT * FROM (VALUES {ENTITIES}) v({', '.join(ENTITY_COLUMNS)}) WHERE kind IN ('METHOD', 'CONSTRUCTOR')), f AS (SELECT * FROM (VALUES {SOURCES}) v(path, text)),
b AS (SELECT qualified_name, array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10)) AS code FROM e JOIN f ON ends_with(path, replace(regexp_extract(parent, '^[^.]+[.][a-z]+[.][A-Za-z]+'), '.', '/') || '.java'))
SELECT replace(qualified_name, '{{r}}', r_regionkey::VARCHAR) AS qualified_name, replace('// ' || qualified_name || chr(10) || code, '{{r}}', r_regionkey::VARCHAR) AS text FROM b, region""")
def java_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds of methods and constructors."""
    entity = projects(spark, sf_dir)[0].entity
    numbers = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n"))
    files = java_samples.files(spark, numbers).select(F.xxhash64("path").alias("file_id"), "text")
    return retrieval.bodies(entity, files).join(entity.select("id", "qualified_name"), "id").select("qualified_name", "text")


SCANNED = {k: v for k, v in (java_samples.SHOP | java_samples.BESIDE).items()}
KEPT = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in SCANNED.items() if k in java_samples.SHOP or k.endswith("Tool.java"))


@query(f"""SELECT path, CASE WHEN starts_with(path, 'tools/') THEN 'tools' ELSE 'root' END AS module, sha256(text) AS sha256, strlen(text)::BIGINT AS size, starts_with(path, 'src/test/') AS test, text FROM (VALUES {KEPT}) v(path, text)""")
def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files as it lies in the shared folder: build folders, other kinds and files over the limit are left out."""
    root = java_samples.store(spark, fresh_folder(spark), SCANNED)
    return trees.scan(spark, root)
