"""Incremental maintenance, portfolio figures, search, retrieval, text functions, source trees and streams."""


import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import incremental, kpi, retrieval, search
from graphloom.sources import trees
from graphloom.streaming import index


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_change_set(spark):
    pairs = lambda d: spark.createDataFrame(list(d.items()), "path string, sha256 string")
    got = incremental.change_set(pairs({"A": "a1", "B": "b1", "C": "c1"}), pairs({"A": "a1", "B": "b2", "D": "d1"}))
    assert {(r.path, r.change) for r in got.collect()} == {("B", "changed"), ("C", "deleted"), ("D", "added")}
    assert incremental.change_set(pairs({"A": "a"}), pairs({"A": "a"})).count() == 0


def test_patch_equals_full_run(spark):
    """A file edited, one added, one deleted; a kept name keeps its id."""
    kinds = "id long, qualified_name string, file_id long"
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], kinds)
    fresh = spark.createDataFrame([("b", 2), ("b2", 2), ("d", 4)], "qualified_name string, file_id long")
    after = incremental.patch_entities(stored, fresh, spark.createDataFrame([(2,), (3,)], "file_id long"))
    rows = {r.qualified_name: r for r in after.collect()}
    assert set(rows) == {"a", "b", "b2", "d"} and rows["b"].id == 2 and rows["a"].id == 1
    edge = "src long, dst long, type string, weight long, file_id long"
    old = spark.createDataFrame([(1, 2, "CALLS", 1, 1), (2, 3, "CALLS", 1, 2), (1, 3, "CALLS", 1, 1)], edge)
    new = spark.createDataFrame([(2, 1, "CALLS", 2, 2)], edge)
    got = incremental.patch_edges(old, new, spark.createDataFrame([(2,)], "file_id long"), after)
    assert {(r.src, r.dst, r.weight) for r in got.collect()} == {(1, 2, 1), (2, 1, 2)}


def test_added_types_wake_files_that_waited_for_them(spark):
    open_ = spark.createDataFrame([(1, "New"), (2, "Other"), (3, "New")], "file_id long, name string")
    got = incremental.waiting(open_, spark.createDataFrame([("New",)], "name string"), spark.createDataFrame([(3,)], "file_id long"))
    assert [r.file_id for r in got.collect()] == [1]


def test_index_counts(spark):
    kinds = "id string, path string, hash string"
    c = lambda *rows: spark.createDataFrame(list(rows), kinds)
    none = spark.createDataFrame([], "path string")
    first = c(("1", "p", "h1"), ("2", "q", "h2"))
    counts = lambda *a: tuple(incremental.index_counts(incremental.index_plan(*a)).first())
    assert counts(spark.createDataFrame([], kinds), first, none) == (2, 0, 0, 2)
    assert counts(first, first, none) == (0, 2, 0, 2)
    assert counts(first, c(("1", "p", "new")), spark.createDataFrame([("q",)], "path string")) == (1, 0, 1, 1)
    assert counts(first, first, none, True) == (2, 0, 0, 2)


def test_stream_keeps_the_index(spark, tmp_path):
    src, at, check = (f"file://{tmp_path}/{x}" for x in ("in", "index", "check"))
    put = lambda rows: spark.createDataFrame(rows, index.EVENTS).coalesce(1).write.mode("append").parquet(src)
    run = lambda: index.maintain(spark.readStream.schema(index.EVENTS).parquet(src), at, check).awaitTermination()
    put([("chunk", "1", "p", "h1", "one"), ("chunk", "2", "q", "h2", "two")])
    run()
    assert {(r.id, r.text) for r in index.current(spark, at).collect()} == {("1", "one"), ("2", "two")}
    put([("chunk", "1", "p", "h9", "uno"), ("removed", None, "q", None, None)])
    run()
    assert {(r.id, r.text) for r in index.current(spark, at).collect()} == {("1", "uno")}
    assert len(index.versions(spark, at)) == 2


def test_portfolio(spark):
    runs = spark.sql("""select * from values (1, 1, 'SUCCESS', timestamp_ntz'2024-01-01 10:00:00', timestamp_ntz'2024-01-01 10:00:01', 1000L), (1, 2, 'FAILED', timestamp_ntz'2024-01-03 10:00:00', timestamp_ntz'2024-01-03 10:00:02', 2000L),
        (2, 3, 'SUCCESS', timestamp_ntz'2024-01-03 09:00:00', timestamp_ntz'2024-01-03 09:00:03', 3001L) as t(project_id, run_id, status, started_at, finished_at, duration_ms)""")
    assert {(r.project_id, r.run_id) for r in kpi.last_runs(runs).collect()} == {(1, 2), (2, 3)}
    days = kpi.activity(runs, "2024-01-03", 3)
    assert [(str(r.day), r.ok, r.failed, r.avg_ms) for r in days.orderBy("day").collect()] == [("2024-01-01", 1, 0, 1000), ("2024-01-02", 0, 0, None), ("2024-01-03", 1, 1, 2501)]
    assert kpi.weighted_mean(days).first().mean_ms == (1000 + 2 * 2501) // 3 and kpi.weighted_mean(days.limit(0)).first().mean_ms is None
    with pytest.raises(ValueError):
        kpi.hotspots(runs, "name")


def test_search(spark):
    rows = [(1, "User", "a.User"), (2, "UserService", "a.UserService"), (3, "find", "a.User#find"), (4, "x_user%", "b"), (5, "superuser", "c")]
    entity = spark.createDataFrame([(i, n, q, "CLASS") for i, n, q in rows], "id long, name string, qualified_name string, kind string")
    assert [r.id for r in search.ranked(entity, " USER ").collect()] == [1, 2, 3, 4, 5]
    assert [r.id for r in search.ranked(entity, "_user%").collect()] == [4] and search.ranked(entity, "  ").count() == 0 == search.ranked(entity, None).count()


def test_retrieval(spark):
    chunks = spark.createDataFrame([("a", "UserService#find(Long)", "x.UserService#find(Long)", "return repo"), ("b", "Order#pay()", "x.Order#pay()", "charge the user service")], "id string, label string, qualified_name string, text string")
    q = spark.createDataFrame([(1, "How does UserService find things")], "query_id long, text string")
    got = {r.id: r.keyword for r in retrieval.keyword_scores(chunks, q).collect()}
    # terms: userservice, user, service, find, things
    assert got["a"] == pytest.approx(4 / 5) and got["b"] == pytest.approx(0.6 / 5)
    pool = spark.createDataFrame([("a", 0.2, 0.8, False), ("b", 0.9, 0.1, False), ("c", 0.0, 0.0, True)], "id string, dense double, keyword double, pinned boolean")
    assert [r.id for r in retrieval.hybrid(pool, 3).collect()] == ["c", "b", "a"]
    packed = retrieval.packed_prompt(spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "ghi"), (2, 1, "x" * 30), (2, 2, "y")], "query_id long, place int, text string"), 9)
    assert {(r.query_id, r.place, r.text) for r in packed.collect()} == {(1, 1, "abcdef"), (1, 2, "ghi"), (2, 1, "x" * 9)}
    files = spark.createDataFrame([("d/a", 200), ("d/b", 90), ("d/c", 50), ("d/d", 400), ("d/e", 1)], "path string, chunks int")
    by = {r.path: r.batch for r in retrieval.batches(files, 300).collect()}
    assert by["d/a"] == by["d/b"] != by["d/c"] != by["d/d"] != by["d/e"]
    assert one(spark, retrieval.dot(retrieval.unit(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1.0), F.lit(0.0)))) == pytest.approx(0.6)


def test_text(spark):
    x = lambda f, s: one(spark, f(F.lit(s)))
    assert x(fn.type_tokens, "@NotNull Map<String, java.util.List<? extends User>>[]") == ["Map", "String", "java.util.List", "User"]
    assert x(fn.erased, "java.util.Map<String, List<X>>[]") == "Map[]" and x(fn.erased, "a.b.String...") == "String[]"
    label = lambda q, k, n="n": one(spark, fn.label(F.lit(q), F.lit(k), F.lit(n)))
    assert label("com.acme.Scope.None", "CLASS") == "Scope.None" and label("com.acme.User#find(Long)", "METHOD") == "User#find(Long)"
    assert label("com.acme.User#<init>(Repo)", "CONSTRUCTOR") == "User(Repo)" and label("endpoint:x", "ENDPOINT", "GET /users") == "GET /users"
    assert x(fn.terms, "How does UserService#findAll work?") == ["all", "find", "findall", "service", "user", "userservice"]
    assert x(fn.mentioned, "does UserService call findAll or find") == ["findall", "userservice"]
    assert x(fn.lines_of_code, "a\n\n  \n b") == 2 and one(spark, fn.excerpt(F.lit("a\nb\nc"), 2, 9)) == "b\nc"
    assert x(fn.repository_name, "https://host/a/My-Repo.git") == "My-Repo" and x(fn.package_of, "com.acme.User#find(Long)") == "com.acme"
    assert [one(spark, fn.duration(F.lit(ms))) for ms in (850, 12_340, 240_000)] == ["850 ms", "12.3 s", "4 min"] and one(spark, fn.percent(F.lit(1), F.lit(3))) == "33%"
    assert [x(fn.is_test, p) for p in ("src/test/a.java", "a/UserIT.java", "a/User.java")] == [True, True, False]
    assert [x(fn.is_source, p) for p in ("a/User.java", "a/package-info.java", "a/b.kt")] == [True, False, False]
    assert one(spark, fn.decoded(F.lit("é".encode()))) == "é" == one(spark, fn.decoded(F.lit("é".encode("latin-1"))))
    assert one(spark, fn.signature(F.lit("METHOD"), F.lit("public"), F.lit("static,final"), F.lit("int"), F.lit("f"), F.lit("int a"))) == "public static final int f(int a)"


def test_tree(spark, tmp_path):
    files = {"pom.xml": "<x/>", "core/pom.xml": "<x/>", "core/src/main/java/A.java": "class A {}", "core/src/test/java/ATest.java": "x", "src/B.java": "class B {}", "core/target/C.java": "x", "src/package-info.java": "", "src/d.txt": "", "src/Big.java": "x" * 50}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = trees.scan(spark, f"file://{tmp_path}", max_bytes=40).collect()
    assert {(r.path, r.module, r.test) for r in got} == {("core/src/main/java/A.java", "core", False), ("core/src/test/java/ATest.java", "core", True), ("src/B.java", "root", False)}
