"""Entities and edges made of the trade tables, so that graph operators have something to run on.

A part is a member of the type (part name, brand); its brand is the package and its kind of make the module. Parts on
consecutive lines of an order depend on each other: those in large quantities, or, inside all_lines, all. Users of the event table are projects and
their events runs; documents are files.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.tables import table

OWNER_BASE, QUANTITY = 1_000_000_000, 40
_least: ContextVar[int | None] = ContextVar("least", default=QUANTITY)


@contextmanager
def all_lines() -> Iterator[None]:
    """Edge tables made inside have every two consecutive lines, whatever their quantities."""
    token = _least.set(None)
    try:
        yield
    finally:
        _least.reset(token)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 17 == 0, "ENDPOINT").when(F.col("p_size") % 7 == 0, "FIELD").otherwise("METHOD")
    part = part.withColumn("kind", kind)
    owner = part.groupBy("p_name", "p_brand").agg(
        F.min("p_partkey").alias("k"), F.min("p_type").alias("module"), F.greatest(F.lit(1), F.coalesce(F.sum(F.when(F.col("kind") == "METHOD", F.col("p_size"))), F.lit(0))).cast("int").alias("complexity")
    )
    member_name = F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))
    members = part.join(owner.select("p_name", "p_brand", "k"), ["p_name", "p_brand"]).select(
        F.col("p_partkey").alias("id"), member_name.alias("name"), F.concat_ws(".", "p_brand", member_name).alias("qualified_name"), "kind", (F.lit(OWNER_BASE) + F.col("k")).alias("parent_id"),
        F.col("p_brand").alias("package_name"), F.col("p_type").alias("module"), F.lit(None).cast("string").alias("stereotype"), F.col("p_size").alias("complexity"), F.lit(False).alias("is_abstract"), (F.col("p_partkey") % 200).alias("file_id"),
    )
    role = F.element_at(F.array(*(F.lit(x) for x in ("CONTROLLER", "SERVICE", "REPOSITORY", "TEST", "COMPONENT", None))), (F.col("k") % 6 + 1).cast("int"))
    types = owner.select(
        (F.lit(OWNER_BASE) + F.col("k")).alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.when(F.col("k") % 4 == 0, "INTERFACE").otherwise("CLASS").alias("kind"),
        F.lit(None).cast("long").alias("parent_id"), F.col("p_brand").alias("package_name"), "module", role.alias("stereotype"), "complexity", (F.col("k") % 4 == 0).alias("is_abstract"), (F.col("k") % 200).alias("file_id"),
    )
    return members.unionByName(types)


def raw_edges(spark: SparkSession, sf_dir: str, quantity: int | None = None) -> DataFrame:
    """A row for each two consecutive lines: src, dst, type, weight 1, order."""
    line, least = table(spark, sf_dir, "lineitem"), _least.get() if quantity is None else quantity
    line = line if least is None else line.where(F.col("l_quantity") >= least)
    a = line.select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("src"), "l_returnflag", (F.col("l_linenumber") + 1).alias("n"))
    b = line.select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("n"))
    kind = F.when(F.col("l_returnflag") == "R", "OVERRIDES").when(F.col("l_returnflag") == "A", "CALLS").otherwise("USES_TYPE")
    return a.join(b, ["order", "n"]).where("src <> dst").select("src", "dst", kind.alias("type"), F.lit(1).cast("long").alias("weight"), "order")


def edges(spark: SparkSession, sf_dir: str, quantity: int | None = None) -> DataFrame:
    return raw_edges(spark, sf_dir, quantity).groupBy("src", "dst", "type").agg(F.sum("weight").alias("weight"))


#: The same as common table expressions of DuckDB.
SQL = f"""owner0 AS (SELECT p_name AS oname, p_brand AS obrand, min(p_partkey) AS k, min(p_type) AS omodule,
    greatest(1, coalesce(sum(CASE WHEN p_size % 17 <> 0 AND p_size % 7 <> 0 THEN p_size END), 0))::INT AS ocomplexity FROM part GROUP BY p_name, p_brand),
entity AS (SELECT p_partkey AS id, p_name || '#' || p_partkey AS name, p_brand || '.' || p_name || '#' || p_partkey AS qualified_name,
    CASE WHEN p_size % 17 = 0 THEN 'ENDPOINT' WHEN p_size % 7 = 0 THEN 'FIELD' ELSE 'METHOD' END AS kind, {OWNER_BASE} + k AS parent_id, p_brand AS package_name, p_type AS module,
    NULL::VARCHAR AS stereotype, p_size AS complexity, false AS is_abstract, p_partkey % 200 AS file_id FROM part JOIN owner0 ON p_name = oname AND p_brand = obrand
  UNION ALL SELECT {OWNER_BASE} + k, oname, obrand || '.' || oname, CASE WHEN k % 4 = 0 THEN 'INTERFACE' ELSE 'CLASS' END, NULL, obrand, omodule,
    CASE k % 6 WHEN 0 THEN 'CONTROLLER' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'REPOSITORY' WHEN 3 THEN 'TEST' WHEN 4 THEN 'COMPONENT' END, ocomplexity, k % 4 = 0, k % 200 FROM owner0),
raw_edge AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, CASE a.l_returnflag WHEN 'R' THEN 'OVERRIDES' WHEN 'A' THEN 'CALLS' ELSE 'USES_TYPE' END AS type, a.l_orderkey AS ord
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_quantity >= {QUANTITY} AND b.l_quantity >= {QUANTITY} AND a.l_partkey <> b.l_partkey),
edge AS (SELECT src, dst, type, count(*)::BIGINT AS weight FROM raw_edge GROUP BY ALL)"""
#: Type graph: edges between the owners of both ends.
ROLLUP_SQL = """owner AS (SELECT id, coalesce(parent_id, id) AS owner_id FROM entity),
rolled AS (SELECT a.owner_id AS src, b.owner_id AS dst, e.type, sum(e.weight)::BIGINT AS weight FROM edge e JOIN owner a ON e.src = a.id JOIN owner b ON e.dst = b.id
    WHERE a.owner_id <> b.owner_id GROUP BY ALL)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, run_id, status, started_at, finished_at, duration_ms."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase', 'view')")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("RUNNING")
    ms = F.floor(F.col("value") * 1000).cast("long")
    done = F.when(F.col("event_type") != "view", F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value")).cast("decimal(18,6)")))
    return e.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("started_at"), done.alias("finished_at"), F.when(F.col("event_type") != "view", ms).alias("duration_ms"))


RUNS_SQL = """runs AS (SELECT user_id AS project_id, event_id AS run_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' ELSE 'RUNNING' END AS status, ts AS started_at,
    CASE WHEN event_type <> 'view' THEN ts + to_seconds(floor(value)::BIGINT) END AS finished_at, CASE WHEN event_type <> 'view' THEN floor(value * 1000)::BIGINT END AS duration_ms
    FROM events WHERE event_type IN ('error', 'purchase', 'view'))"""
