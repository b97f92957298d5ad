"""Registered queries over the driver tables, with their SQL."""

from __future__ import annotations

from linkloom.plans import extract_queries, join_queries, rule_queries, run_queries, stat_queries, uri_queries

_PARTS = (join_queries, uri_queries, extract_queries, rule_queries, run_queries, stat_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
