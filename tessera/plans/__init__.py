"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import analytics, artifacts, assistant, concepts, corpus, growing, ingest, knowledge, learning, overview, retrieval, structure  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
