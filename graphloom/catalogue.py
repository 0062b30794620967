"""The library's queries over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from graphloom.plans import graph_queries, index_queries, java_queries, lookup_queries, maintenance_queries, metric_queries, portfolio_queries, report_queries, retrieval_queries, source_queries, whole_queries

FLAGSHIP = "risk_scores"
PARTS = (graph_queries, index_queries, java_queries, lookup_queries, maintenance_queries, metric_queries, portfolio_queries, report_queries, retrieval_queries, source_queries, whole_queries)
QUERIES = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in PARTS for k, v in part.ORACLES.items()}
