"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from keyloom.plans import data_queries, log_queries, replica_queries, source_queries, store_queries

_MODULES = (data_queries, store_queries, replica_queries, log_queries, source_queries)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
