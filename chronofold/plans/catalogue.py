"""All named queries of the library with their oracle SQL."""

from __future__ import annotations

from chronofold.plans import log_queries, read_queries, system_queries, workload_queries

_PARTS = (read_queries.R, log_queries.R, workload_queries.R, system_queries.R)
QUERIES: dict = {name: fn for r in _PARTS for name, fn in r.queries.items()}
ORACLES: dict = {name: sql for r in _PARTS for name, sql in r.oracles.items()}
