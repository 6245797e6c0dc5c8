"""All queries by name, with their oracle SQL."""

from __future__ import annotations

from weftline.plans import file_queries, link_queries, sense_queries, text_queries  # noqa: F401  entering queries is what this import is for
from weftline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
