"""Ranking metrics over arrays of ids: what was retrieved, in order, and what is relevant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _top(retrieved: Column, k: int | None) -> Column:
    return retrieved if k is None or k <= 0 else F.slice(retrieved, 1, k)


def _hits(retrieved: Column, relevant: Column, k: int | None) -> Column:
    return F.size(F.array_intersect(_top(retrieved, k), relevant))


def recall_at_k(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """Hits over the number of relevant ids; 0 without any."""
    n = F.size(F.array_distinct(relevant))
    return F.when(n == 0, 0.0).otherwise(_hits(retrieved, relevant, k) / n)


def precision_at_k(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """Hits over k; k out of range means all that was retrieved."""
    n = F.size(retrieved) if k is None or k <= 0 else F.when(F.size(retrieved) < k, F.size(retrieved)).otherwise(F.lit(k))
    return F.when(n == 0, 0.0).otherwise(_hits(retrieved, relevant, k) / n)


def f1_at_k(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    p, r = precision_at_k(retrieved, relevant, k), recall_at_k(retrieved, relevant, k)
    return F.when(p + r < 1e-10, 0.0).otherwise(2 * p * r / (p + r))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """1 over the place of the first relevant id; its mean over queries is the MRR."""
    first = F.array_min(F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1 / first, F.lit(0.0))


def ndcg_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    gains = F.transform(_top(retrieved, k), lambda x, i: F.when(F.array_contains(relevant, x), 1 / F.log2(i + 2)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.size(relevant)), F.lit(1))), lambda i: 1 / F.log2(i + 1))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(relevant) == 0, 0.0).otherwise(add(gains) / add(ideal))
