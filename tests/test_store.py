import pytest

from graphloom.operators import analysis, retrieval
from graphloom.operators.store import ABANDONED, Store
from graphloom.sources import java_samples


def test_tables_of_projects(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    store.replace(1, entity=rows(1, 2), edge=rows(9))
    store.replace(2, entity=rows(3))
    assert {r.id for r in store.load("entity", 1).collect()} == {1, 2}
    store.replace(1, entity=store.load("entity", 1).where("id > 1").unionByName(rows(7)))  # read and written at once
    assert {r.id for r in store.load("entity", 1).collect()} == {2, 7} and store.load("edge", 1).count() == 1
    store.replace(1, entity_metric=rows())
    assert store.load("entity_metric", 1).count() == 0
    store.delete(1)
    assert not store.has("entity", 1) and not store.has("edge", 1) and store.load("entity", 2).count() == 1
    assert store.load("entity", 5, "id long").collect() == []


def test_runs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    first = store.begin(4, "FULL")
    store.finish(4, first)
    second = store.begin(4, "INCREMENTAL")
    third = store.begin(4, "FULL")
    store.finish(4, third, "no sources")
    rows = {r.run_id: r for r in store.runs(4).collect()}
    assert (first, second, third) == (1, 2, 3)
    assert [(rows[i].status, rows[i].error) for i in (1, 2, 3)] == [("SUCCESS", None), ("FAILED", ABANDONED), ("FAILED", "no sources")]
    assert all(r.duration_ms >= 0 for r in rows.values())


def test_names_that_a_new_type_answers_wake_files(spark):
    """b.B names C, which comes later: the incremental run resolves b.B again, though nothing in it has changed."""
    from pyspark.sql import functions as F

    texts = {"p/A.java": "package p; class A { }", "p/B.java": "package p; class B { C c; A a; }"}
    files = lambda t: spark.createDataFrame([(p, "root", x) for p, x in t.items()], "path string, module string, text string").withColumn("sha256", F.sha2("text", 256))
    before = analysis.full(spark, files(texts))
    after, counts = analysis.incremental_run(spark, before, files(texts | {"p/C.java": "package p; class C { }"}))
    assert counts == {"added": 1, "changed": 0, "deleted": 0, "dependent": 0, "waiting": 1}
    name = {r.id: r.qualified_name for r in after.entity.collect()}
    assert {(name[r.src], name[r.dst]) for r in after.edge.collect()} == {("p.B#c", "p.C"), ("p.B#a", "p.A")}
    assert analysis.incremental_run(spark, after, files(texts | {"p/C.java": "package p; class C { }"}))[1]["added"] == 0
    assert java_samples.SHOP.keys() > {k for k, v in java_samples.EDITED.items() if v is None}


def test_batches_in_order_of_path(spark):
    import random

    r = random.Random(2)
    counts = {f"d{r.randrange(9)}/f{i:04}": r.choice([0, 1, 40, 99, 150, 299, 300, 301, 900]) for i in range(400)}
    got = {x.path: x.batch for x in retrieval.batches(spark.createDataFrame(list(counts.items()), "path string, chunks long").repartition(5)).collect()}
    want, used, batch = {}, 0, 0
    for path in sorted(counts):
        n = counts[path]
        if not n:
            continue
        if used and used + n > 300:
            used, batch = 0, batch + 1
        used += n
        want[path] = batch
    assert got == want


def folders(tmp_path, project=1):
    return {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("bucket_=*") if f"project_id={project}" in str(p)}


def test_a_patch_writes_the_buckets_of_its_files_only(spark, tmp_path):
    from pyspark.sql import functions as F

    store = Store(spark, f"file://{tmp_path}/store", buckets=8)
    entity = spark.range(400).select("id", (F.col("id") % 100).alias("file_id"), F.lit("old").alias("name"))
    edge = entity.select(F.col("id").alias("src"), ((F.col("id") + 1) % 400).alias("dst"), "file_id")
    store.replace(1, entity=entity, edge=edge)
    before = folders(tmp_path)
    assert len(before) == 16
    files = spark.createDataFrame([(7,)], "file_id long")
    fresh = spark.createDataFrame([(7, 7, "new"), (900, 7, "new")], "id long, file_id long, name string")
    hit = store.patch(1, files, entity=fresh, edge=edge.where("false"))
    more = folders(tmp_path) - before
    assert len(hit) == 1 and len(more) == 2 and all(x.endswith(f"bucket_={hit[0]}") for x in more)
    want = {(r.id, r.name) for r in entity.where("file_id <> 7").collect()} | {(7, "new"), (900, "new")}
    assert {(r.id, r.name) for r in store.load("entity", 1).collect()} == want
    assert store.load("edge", 1).count() == 396
    assert store.vacuum(1) == 2 and {(r.id, r.name) for r in store.load("entity", 1).collect()} == want
    # a file that is gone, and all files
    store.patch(1, files, entity=fresh.where("false"), edge=edge.where("false"))
    assert store.load("entity", 1).where("file_id = 7").count() == 0
    store.patch(1, entity.select("file_id").distinct(), entity=fresh.where("false"), edge=edge.where("false"))
    assert store.load("entity", 1).collect() == [] and store.load("entity", 1).columns == ["id", "file_id", "name"]


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda *x: spark.createDataFrame([(i, i) for i in x], "id long, file_id long")
    store.replace(1, entity=rows(1, 2), edge=rows(3))

    def failing(*_):
        raise OSError("no more")

    with monkeypatch.context() as m:
        m.setattr("graphloom.operators.store.Pointer.swap", failing)
        with pytest.raises(OSError):
            store.replace(1, entity=rows(5), edge=rows(6))
        with pytest.raises(OSError):
            store.patch(1, rows(1), entity=rows(1))
    assert {r.id for r in store.load("entity", 1).collect()} == {1, 2} and {r.id for r in store.load("edge", 1).collect()} == {3}
    store.patch(1, rows(2), entity=rows(2).where("false"))
    assert {r.id for r in store.load("entity", 1).collect()} == {1}


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda *x: spark.createDataFrame([(i, i) for i in x], "id long, file_id long")
    store.replace(1, entity=rows(1, 2))
    seen = store.load("entity", 1)
    store.patch(1, rows(1), entity=rows(1).where("false"))
    assert {r.id for r in seen.collect()} == {1, 2} and {r.id for r in store.load("entity", 1).collect()} == {2}
