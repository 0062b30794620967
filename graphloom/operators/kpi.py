"""Portfolio figures: counts, last runs, daily activity, totals, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.schema import METHOD_KINDS, TYPE_KINDS
from graphloom.tables import mean, rounded


def entity_counts(entity: DataFrame, by: str) -> DataFrame:
    """Per project: types, methods, endpoints, tests."""
    is_type = F.col("kind").isin(*TYPE_KINDS)
    return entity.groupBy(by).agg(
        F.count_if(is_type).alias("types"), F.count_if(F.col("kind").isin(*METHOD_KINDS)).alias("methods"), F.count_if(F.col("kind") == "ENDPOINT").alias("endpoints"), F.count_if(is_type & F.coalesce(F.col("stereotype") == "TEST", F.lit(False))).alias("tests")
    )


def risk_bands(risks: DataFrame, by: str) -> DataFrame:
    """Per project: high, medium, low, avg_risk (3 places), max_risk. Risks are tenths."""
    n = lambda x: F.count_if(F.col("level") == x).alias(x.lower())
    return risks.groupBy(by).agg(n("HIGH"), n("MEDIUM"), n("LOW"), rounded(mean(F.col("risk"), 10)).alias("avg_risk"), F.max("risk").alias("max_risk"))


def last_runs(runs: DataFrame, n: int = 1, by: str = "project_id") -> DataFrame:
    """The latest n runs of each project, by start, then id."""
    n = min(max(n, 1), 20)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("started_at"), F.desc("run_id")))
    return runs.withColumn("place", place).where(F.col("place") <= n).drop("place")


def activity(runs: DataFrame, last_day: str, days: int = 14) -> DataFrame:
    """day, ok, failed, avg_ms of each of the days up to last_day, empty ones too. A run belongs to the day in UTC on which it
    started; avg_ms is the rounded mean over all of the day's runs that have a duration, whatever came of them."""
    last = F.to_date(F.lit(last_day))
    spine = runs.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    started = F.col("started_at") if dict(runs.dtypes)["started_at"] == "timestamp_ntz" else F.to_utc_timestamp("started_at", F.current_timezone())
    by_day = runs.withColumn("day", F.to_date(started)).groupBy("day").agg(
        F.count_if(F.col("status") == "SUCCESS").alias("ok"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.floor(F.avg("duration_ms") + 0.5).alias("avg_ms")
    )
    return spine.join(by_day, "day", "left").select("day", F.coalesce("ok", F.lit(0)).cast("long").alias("ok"), F.coalesce("failed", F.lit(0)).cast("long").alias("failed"), "avg_ms")


def weighted_mean(days: DataFrame) -> DataFrame:
    """mean_ms: of the days' means by their finished runs, failed ones too, in whole numbers; days without a mean don't count.
    Null without finished runs."""
    n = F.when(F.col("avg_ms").isNotNull(), F.col("ok") + F.col("failed"))
    return days.agg(F.sum(F.col("avg_ms") * n).alias("total"), F.sum(n).alias("weight")).select(F.when(F.col("weight") > 0, F.expr("total div weight")).alias("mean_ms"))


FIGURES = ("files", "loc", "types", "methods", "endpoints", "tests", "edges", "high", "medium", "low")


def portfolio_totals(projects: DataFrame, days: DataFrame) -> DataFrame:
    """One row over all projects (status, analyzing and FIGURES) and days of activity: projects, ready, analyzing, failed, the
    sums of FIGURES, runs, failed_runs, mean_ms. A project under analysis counts as that, whatever its status was."""
    idle = lambda s: F.count_if(~F.col("analyzing") & (F.col("status") == s))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in FIGURES]
    all_ = projects.agg(F.count("*").alias("projects"), idle("READY").alias("ready"), F.count_if("analyzing").alias("analyzing"), idle("FAILED").alias("failed"), *sums)
    ran = days.agg(F.coalesce(F.sum(F.col("ok") + F.col("failed")), F.lit(0)).cast("long").alias("runs"), F.coalesce(F.sum("failed"), F.lit(0)).cast("long").alias("failed_runs"))
    return all_.join(ran, how="cross").join(weighted_mean(days), how="cross")  # rows of one


def totals(counts: DataFrame, last: DataFrame) -> DataFrame:
    """projects, entities, running, ready, failed over all projects; a run under way overrides what was before."""
    both = counts.join(last.select("project_id", "status"), "project_id", "left")
    n = lambda s: F.count_if(F.col("status") == s)
    return both.agg(F.count("*").alias("projects"), F.sum("n").cast("long").alias("rows"), n("RUNNING").alias("running"), n("SUCCESS").alias("ready"), n("FAILED").alias("failed"))


def hotspots(rows: DataFrame, sort: str = "risk", n: int = 20, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The n greatest by one of the known columns, ties by id."""
    if sort not in ("risk", "complexity", "fan_in", "fan_out", "dependents", "depth"):
        raise ValueError(f"cannot sort by {sort}")
    rows = rows.where(F.col("kind").isin(*kinds)) if kinds else rows
    return rows.orderBy(F.desc(sort), "id").limit(min(max(n, 1), 200))


def run_change(runs: DataFrame) -> DataFrame:
    """project_id, duration_ms and change of the last successful run against the one before."""
    w = Window.partitionBy("project_id").orderBy("started_at", "run_id")
    ok = runs.where("status = 'SUCCESS'").withColumn("before", F.lag("duration_ms").over(w)).withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("started_at"), F.desc("run_id"))))
    return ok.where("place = 1").select("project_id", "duration_ms", (F.col("duration_ms") - F.col("before")).alias("change"))


def merged_points(groups: DataFrame) -> DataFrame:
    """Groups with equal instability and abstractness (2 places) as one point: names (sorted), n."""
    return groups.groupBy(rounded(F.col("instability"), 2).alias("x"), rounded(F.col("abstractness"), 2).alias("y")).agg(F.array_join(F.array_sort(F.collect_list("grp")), ",").alias("names"), F.count("*").alias("n"))


def modules_by_instability(groups: DataFrame) -> DataFrame:
    """Groups with their place: the least stable first, ties by name."""
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("instability"), "grp")))  # a row for each module


def latest_reports(reports: DataFrame, n: int = 20) -> DataFrame:
    """The latest n reports of each project, with their place: by creation, then id."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("report_id")))
    return reports.withColumn("place", place).where(F.col("place") <= n)


def overview(scored: DataFrame) -> DataFrame:
    """One row over types, methods and constructors: high, medium, low, mean_risk, max_risk, mean_complexity and max_complexity
    (of methods and constructors), max_depth, exposed; 0 where there are none."""
    rows = scored.where(F.col("kind").isin(*TYPE_KINDS, *METHOD_KINDS))
    n, method = (lambda x: F.count_if(F.col("level") == x).alias(x.lower())), F.col("kind").isin(*METHOD_KINDS)
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return rows.agg(
        n("HIGH"), n("MEDIUM"), n("LOW"), zero(rounded(mean(F.col("risk"), 10)), "mean_risk"), zero(F.max("risk"), "max_risk"), zero(rounded(mean(F.when(method, F.col("complexity")))), "mean_complexity"),
        zero(F.max(F.when(method, F.col("complexity"))), "max_complexity"), zero(F.max("depth"), "max_depth"), F.count_if("exposed").alias("exposed"),
    )


def page(entity: DataFrame, scored: DataFrame, cycle_types: DataFrame) -> DataFrame:
    """One row of an overview: scored (types, methods and constructors with a risk), low_share (of these; 0 without any),
    complex_methods (complexity of 10 or more), production_types (that are no tests), cycle_types (id: types in cycles)."""
    rows = scored.where(F.col("kind").isin(*TYPE_KINDS, *METHOD_KINDS))
    figures = rows.agg(F.count("*").alias("scored"), F.coalesce(rounded(F.count_if(F.col("level") == "LOW").cast("double") / F.nullif(F.count("*"), F.lit(0)).cast("double")), F.lit(0.0)).alias("low_share"), F.count_if(F.col("kind").isin(*METHOD_KINDS) & (F.col("complexity") >= 10)).alias("complex_methods"))
    types = entity.where(F.col("kind").isin(*TYPE_KINDS)).agg(F.count_if(~F.coalesce(F.col("stereotype") == "TEST", F.lit(False))).alias("production_types"))
    return figures.join(types, how="cross").join(cycle_types.agg(F.count_distinct("id").alias("cycle_types")), how="cross")  # rows of one


def worst_groups(groups: DataFrame, n: int = 8) -> DataFrame:
    """The n groups (grp, distance) furthest from the main sequence, ties by name."""
    return groups.orderBy(F.desc("distance"), "grp").limit(n)


def file_stats(files: DataFrame, by: str = "project_id") -> DataFrame:
    """by, files, loc, parse_errors: of source files (by, loc, parse_error: null where parsing went well)."""
    return files.groupBy(by).agg(F.count("*").alias("files"), F.coalesce(F.sum("loc"), F.lit(0)).cast("long").alias("loc"), F.count("parse_error").alias("parse_errors"))


def scalar_counts(entity: DataFrame, edge: DataFrame, files: DataFrame) -> DataFrame:
    """One row: entities, edges, files, endpoints, parse_errors."""
    counts = entity.agg(F.count("*").alias("entities"), F.count_if(F.col("kind") == "ENDPOINT").alias("endpoints"))
    counts = counts.join(edge.agg(F.count("*").alias("edges")), how="cross")  # rows of one
    return counts.join(files.agg(F.count("*").alias("files"), F.count("parse_error").alias("parse_errors")), how="cross")  # rows of one
