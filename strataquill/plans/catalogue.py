"""The catalogue of core queries."""

from __future__ import annotations

from strataquill.plans import data_queries, evidence_queries, fact_queries, intake_queries, retrieval_queries

PARTS = (data_queries, retrieval_queries, fact_queries, evidence_queries, intake_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
FLAGSHIP = "rrf_fusion"
