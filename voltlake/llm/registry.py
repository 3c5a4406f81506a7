"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from voltlake.llm import cluster_queries, percentiles, text_queries

_MODULES = (cluster_queries, percentiles, text_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
