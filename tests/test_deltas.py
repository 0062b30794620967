import datetime as dt
import random

import pytest

from graphloom.streaming import projects
from graphloom.streaming.deltas import SCHEMA, DeltaIndex


def put(project, path, i, seq, text="t", action="put"):
    return (project, path, i, seq, action, f"h{text}", text, [1.0])


def state(index):
    return sorted((r.project_id, r.path, r.id, r.text) for r in index.read().collect())


def files(tmp_path):
    return {str(p): p.stat().st_size for p in tmp_path.rglob("*.parquet")}


def test_changes_write_themselves_only(spark, tmp_path):
    index = DeltaIndex(spark, f"file://{tmp_path}/index", "model/a", least=100)
    rows = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    assert state(index) == []
    assert index.apply(rows(*(put(1, f"p{i}", "a", 1) for i in range(500))), 0)
    assert index.counts() == {"base": 500, "deltas": 0}
    before = files(tmp_path)
    assert index.apply(rows(put(1, "p0", "a", 2, "new"), put(1, "p1", "a", 2, action="drop"), put(2, "q", "b", 1)), 1)
    assert not index.apply(rows(put(1, "p0", "a", 3, "again")), 1)  # the batch is run again
    after = files(tmp_path)
    assert {k: v for k, v in after.items() if k in before} == before and index.counts() == {"base": 500, "deltas": 3}
    want = sorted([(1, f"p{i}", "a", "t") for i in range(2, 500)] + [(1, "p0", "a", "new"), (2, "q", "b", "t")])
    assert state(index) == want
    assert state(DeltaIndex(spark, f"file://{tmp_path}/index", "model/b")) == []  # another embedder's
    index.apply(rows(put(1, "p0", "a", 1, "old")), 2)  # older than what is there
    assert state(index) == want
    index.compact()
    assert state(index) == want and index.counts() == {"base": 500, "deltas": 0}
    assert index.vacuum() == 4 and state(index) == want


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    index = DeltaIndex(spark, f"file://{tmp_path}/index", "m")
    index.apply(spark.createDataFrame([put(1, "p", "a", 1)], SCHEMA), 0)

    def failing(*_):
        raise OSError

    with monkeypatch.context() as m:
        m.setattr("graphloom.streaming.deltas.Pointer.swap", failing)
        with pytest.raises(OSError):
            index.apply(spark.createDataFrame([put(1, "p", "a", 2, "x")], SCHEMA), 1)
        with pytest.raises(OSError):
            index.compact()
    assert state(index) == [(1, "p", "a", "t")] and index.apply(spark.createDataFrame([put(1, "p", "a", 2, "x")], SCHEMA), 1)
    assert state(index) == [(1, "p", "a", "x")]


def run(spark, tmp_path, name, lots, **options):
    """The index after each lot of events has come as a file, one a batch."""
    at = tmp_path / name
    for lot in lots:
        lot = [(p, seq, dt.datetime(2024, 1, 1) + dt.timedelta(hours=seq), *rest) for p, seq, *rest in lot]
        spark.createDataFrame(lot, projects.EVENTS).coalesce(1).write.mode("append").parquet(f"file://{at}/events")
    index = DeltaIndex(spark, f"file://{at}/index", "m", least=20)
    stream = spark.readStream.schema(projects.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"file://{at}/events")
    query = projects.maintain(stream, index, f"file://{at}/checkpoint", **options)
    query.awaitTermination()
    assert query.exception() is None
    return state(index), index


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, projects.PROVIDER)
    yield
    spark.conf.set(key, before)


def test_events_in_any_order_give_the_same_index(spark, tmp_path, rocks):
    r = random.Random(5)
    events = []
    for project in (1, 2, 3):
        for seq in range(1, 13):
            if seq == 6 and project != 2 or seq == 12 and project == 3:
                events.append((project, seq, "delete", None, None))
            else:
                chunks = [{"id": f"c{k}", "hash": f"h{v}", "text": f"v{v}"} for k in range(r.randint(0, 3)) for v in [r.randint(0, 2)]]
                events.append((project, seq, "update", f"p{r.randint(0, 2)}", chunks))
    want, paths = set(), {}
    for project, seq, kind, path, chunks in events:
        if kind == "delete":
            paths = {k: v for k, v in paths.items() if k[0] != project}
        else:
            paths[project, path] = chunks
    want = sorted((p, path, c["id"], c["text"]) for (p, path), chunks in paths.items() for c in chunks)
    assert run(spark, tmp_path, "ordered", [events[i : i + 12] for i in (0, 12, 24)])[0] == want
    mixed = [*events, *r.sample(events, 12)]
    r.shuffle(mixed)
    assert run(spark, tmp_path, "mixed", [mixed[i : i + 12] for i in range(0, 48, 12)])[0] == want
    assert all(p != 3 for p, *_ in want) and want


def test_what_is_gone_is_forgotten_in_time(spark, tmp_path, rocks):
    """Events may be an hour late: a deletion is remembered until no older event can come."""
    chunk = [{"id": "c", "hash": "h", "text": "t"}]
    lots = [[(1, 5, "update", "p", chunk)], [(1, 6, "delete", None, None)], [(1, 5, "update", "p", chunk)], [(2, 20, "update", "q", chunk)], [(2, 21, "update", "r", chunk)], [(1, 22, "update", "p", chunk)]]
    got, _ = run(spark, tmp_path, "hours", lots, remembered=3600)
    assert got == [(1, "p", "c", "t"), (2, "q", "c", "t"), (2, "r", "c", "t")]


def test_lots_of_events_are_files_of_several_tasks(spark, tmp_path):
    from graphloom.plans.maintenance_queries import in_lots

    in_lots(spark, spark.range(300).withColumnRenamed("id", "seq"), f"file://{tmp_path}/events", 4)
    assert len(list((tmp_path / "events").glob("*.parquet"))) == 12
    assert spark.read.parquet(f"file://{tmp_path}/events").distinct().count() == 300
