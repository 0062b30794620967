import random

from pyspark.sql import functions as F

from graphloom.operators import kpi, search, trigrams, upkeep

ROW = "id long, file_id long, project_id long, kind string, stereotype string, risk double"


def test_figures_after_random_edits(spark):
    r = random.Random(3)
    new = lambda i, f: (i, f, f % 4, r.choice(["CLASS", "INTERFACE", "METHOD", "CONSTRUCTOR", "ENDPOINT", "FIELD"]), r.choice(["TEST", "SERVICE", None]), r.choice([None, r.randint(0, 1000) / 10]))
    rows = {i: new(i, i % 30) for i in range(300)}
    frame = lambda x: spark.createDataFrame(list(x), ROW)
    kept = upkeep.counted(frame(rows.values()))
    for step in range(20):
        files = set(r.sample(range(32), r.randint(1, 4)))
        out = [x for x in rows.values() if x[1] in files]
        into = [new(10_000 * step + 100 * f + 400 + k, f) for f in files for k in range(r.randint(0, 12))]
        rows = {i: x for i, x in rows.items() if x[1] not in files} | {x[0]: x for x in into}
        kept = upkeep.changed(kept, frame(out), frame(into))
        if step % 5 == 4:
            kept = spark.createDataFrame(kept.collect(), kept.schema)
    full = frame(rows.values())
    by = {x["project_id"]: x for x in kpi.entity_counts(full, "project_id").collect()}
    level = F.when(F.col("risk") >= 60, "HIGH").when(F.col("risk") >= 30, "MEDIUM").otherwise("LOW")
    bands = {x["project_id"]: x for x in kpi.risk_bands(full.where("risk is not null").withColumn("level", level), "project_id").collect()}
    got = {x["project_id"]: x for x in upkeep.figures(kept).collect()}
    assert set(got) == set(by)
    for p, x in got.items():
        assert all(x[c] == by[p][c] for c in ("types", "methods", "endpoints", "tests"))
        assert all(x[c] == bands[p][c] for c in ("high", "medium", "low", "avg_risk", "max_risk"))
    assert upkeep.totals(kept).first()["methods"] == sum(x["methods"] for x in by.values())


def test_search_by_trigrams(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abAB") for _ in range(r.randint(1, 8))), "p." + "".join(r.choice("abXé") for _ in range(r.randint(1, 12))), "CLASS") for i in range(400)]
    entity = spark.createDataFrame(rows, "id long, name string, qualified_name string, kind string")
    index = trigrams.Trigrams(spark, f"file://{tmp_path}/grams")
    index.build(entity)
    asked = ["abab", " BA ", "a", "xé", "p.a", "zzz", "", "bbb", "abababababab"]
    got = {}
    for x in trigrams.ranked_all(index, entity, spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 15).collect():
        got.setdefault(x["query_id"], []).append((x["place"], x["id"], x["rank"]))
    for i, q in enumerate(asked):
        want = [(n + 1, x["id"], x["rank"]) for n, x in enumerate(search.ranked(entity, q, n=15).collect())]
        assert sorted(got.get(i, [])) == want, q
    # the postings of one trigram are read, in one bucket
    plan = index.candidates(spark.createDataFrame([(1, "abab")], "query_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "(bucket#" in plan and "EqualTo(gram,bab)" in plan
