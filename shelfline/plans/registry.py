"""All registered queries and their oracle SQL."""

from __future__ import annotations

from shelfline.plans import queries_catalog, queries_crawl, queries_history, queries_ingest, queries_scalar

_PARTS = [queries_history, queries_ingest, queries_catalog, queries_crawl, queries_scalar]

QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
