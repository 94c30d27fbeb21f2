"""All queries of the evidence engine and their SQL, by name."""

from __future__ import annotations

from .plans import evidence_queries, graph_queries  # noqa: F401  (register their queries)
from .plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
