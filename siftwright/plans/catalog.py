"""Every registered query and the SQL that checks it."""

from __future__ import annotations

from siftwright.plans import audit_queries, relational_queries, review_queries, search_queries  # noqa: F401
from siftwright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
