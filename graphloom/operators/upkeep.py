"""Portfolio figures kept up to date by changes: a change set's rows come in with one sign and go out with the other.

What is kept is how often each value occurs in each project: counts add up, and a greatest value that goes gives way to the
next one, without a look at the rows that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.metrics import HIGH, MEDIUM
from graphloom.schema import METHOD_KINDS, TYPE_KINDS
from graphloom.tables import rounded

FIGURES = ("types", "methods", "endpoints", "tests", "high", "medium", "low")


def counted(rows: DataFrame, by: str = "project_id") -> DataFrame:
    """by, measure, value, n: how often each value occurs. rows: by, kind, stereotype, and risk (tenths; null: not scored)."""
    is_type, test = F.col("kind").isin(*TYPE_KINDS), F.coalesce(F.col("stereotype") == "TEST", F.lit(False))
    tenths = F.round(F.col("risk") * 10).cast("long")
    flag = lambda name, on: F.when(on, F.struct(F.lit(name).alias("measure"), F.lit(0).cast("long").alias("value")))
    flags = (flag("types", is_type), flag("methods", F.col("kind").isin(*METHOD_KINDS)), flag("endpoints", F.col("kind") == "ENDPOINT"), flag("tests", is_type & test))
    risk = F.when(tenths.isNotNull(), F.struct(F.lit("risk").alias("measure"), tenths.alias("value")))
    return rows.select(by, F.inline(F.array_compact(F.array(*flags, risk)))).groupBy(by, "measure", "value").agg(F.count("*").alias("n"))


def changed(kept: DataFrame, out: DataFrame, into: DataFrame, by: str = "project_id") -> DataFrame:
    """What is kept after rows have gone out and come in. Only these are counted; what is kept is as long as there are projects
    and different values."""
    minus = counted(out, by).withColumn("n", -F.col("n"))
    return kept.unionByName(counted(into, by)).unionByName(minus).groupBy(by, "measure", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def figures(kept: DataFrame, by: str = "project_id") -> DataFrame:
    """by, FIGURES, avg_risk (3 places) and max_risk, null where nothing is scored."""
    risk, value = F.col("measure") == "risk", F.col("value")
    n = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).alias(name)
    within: list[tuple[str, Column]] = [("high", value >= HIGH * 10), ("medium", (value >= MEDIUM * 10) & (value < HIGH * 10)), ("low", value < MEDIUM * 10)]
    mean = F.sum(F.when(risk, value * F.col("n"))).cast("double") / (F.sum(F.when(risk, F.col("n"))).cast("double") * 10)
    return kept.groupBy(by).agg(*(n(F.col("measure") == c, c) for c in FIGURES[:4]), *(n(risk & on, c) for c, on in within), rounded(mean).alias("avg_risk"), (F.max(F.when(risk, value)) / 10).alias("max_risk"))


def totals(kept: DataFrame, by: str = "project_id") -> DataFrame:
    """One row: projects and the sums of FIGURES."""
    return figures(kept, by).agg(F.count("*").alias("projects"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FIGURES))
