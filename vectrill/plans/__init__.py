"""Query plans over the test tables."""

from __future__ import annotations

from vectrill.plans import analytics, knn, monitoring, relational, searching, vectors
from vectrill.plans.registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
