"""Index advice, routing heuristics, tenancy and monitoring over plain DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# ---- advice


def tune_hnsw(rows: int, dims: int = 0, memory_mb: float | None = None) -> dict:
    """m and ef_search by the number of rows; a quarter less m where the graph would exceed the memory."""
    m, ef = next(x for limit, x in ((10_000, (12, 32)), (100_000, (16, 64)), (1_000_000, (24, 128)), (math.inf, (32, 200))) if rows < limit)
    if memory_mb is not None and rows * (dims * 4 + m * 8) / 1e6 > memory_mb:
        m = int(m * 0.75)
    return {"m": m, "ef_construction": 200, "ef_search": ef}


def tune_ivf(rows: int) -> dict:
    lists = max(10, round(math.sqrt(max(rows, 0)) / 10) * 10)
    return {"lists": lists, "probes": max(1, lists // 10)}


def recommend_index(rows: int, updates: int = 0) -> str:
    return "ivf" if rows > 10_000_000 or updates > rows / 10 else "hnsw"


def tune_query(ef_search: int, recall: float, latency_ms: float, *, target_recall: float = 0.95, target_latency_ms: float = 100.0) -> int:
    """A fifth more where recall is low, else a fifth less where latency is high, within 16 to 512."""
    factor = 1.2 if recall < target_recall else 0.8 if latency_ms > target_latency_ms else 1.0
    return int(min(512, max(16, ef_search * factor)))


def auto_route(query: str, dims: int = 0) -> str:
    return "ann" if dims > 128 or any(w in query.lower() for w in ("similarity", "vector")) else "exact"


def scale_precision(memory_share: float, recall: float) -> str:
    if memory_share > 0.8 or recall < 0.85:
        return "int8"
    return "fp16" if memory_share > 0.6 or recall < 0.90 else "float32"


def select_replica(replicas: list[tuple[str, float, float]]) -> str:
    """Of (name, latency, recall) the least latency * (1 - recall); the name breaks ties."""
    return min(replicas, key=lambda r: (r[1] * (1 - r[2]), r[0]))[0]


def window_rank(partition: str) -> int:
    """djb2 of the name modulo ten, from 1."""
    h = 5381
    for b in partition.encode():
        h = (h * 33 + b) & 0xFFFFFFFF
    return h % 10 + 1


# ---- tenancy


def for_tenant(df: DataFrame, column: str, tenant) -> DataFrame:
    return df.filter(F.col(column) == tenant)


def apply_policies(df: DataFrame, policies: list[str]) -> DataFrame:
    """Rows that every policy (an SQL condition) lets through."""
    for p in policies:
        df = df.filter(p)
    return df


def quota_usage(usage: DataFrame, quotas: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """usage (tenant, vectors, storage_bytes, qps) beside quotas (tenant, max_vectors, max_storage, max_qps):
    shares of each limit, and whether one is exceeded. A tenant without a quota is unlimited."""
    d = usage.join(quotas, tenant, "left")

    def share(a: str, b: str) -> Column:
        return F.round(F.col(a) / F.when(F.col(b) != 0, F.col(b)) * 100, 2)

    over = F.lit(False)
    for a, b in (("vectors", "max_vectors"), ("storage_bytes", "max_storage"), ("qps", "max_qps")):
        over = over | F.coalesce(F.col(a) > F.col(b), F.lit(False))
    return d.select("*", share("vectors", "max_vectors").alias("vector_usage_pct"), share("storage_bytes", "max_storage").alias("storage_usage_pct"), over.alias("exceeded"))


def check_quota(usage: DataFrame, quotas: DataFrame, tenant_value, extra: int, tenant: str = "tenant_id") -> bool:
    row = usage.filter(F.col(tenant) == tenant_value).join(quotas, tenant, "left").select("vectors", "max_vectors").first()
    return row is None or row[1] is None or row[0] + extra <= row[1]


# ---- monitoring


def latency_histogram(calls: DataFrame, latency: str, buckets: list[float]) -> DataFrame:
    """(bucket, count, cumulative) of latencies by the least bound that holds them; the last is open."""
    bound = F.lit(float("inf"))
    for b in sorted(buckets, reverse=True):
        bound = F.when(F.col(latency) <= b, F.lit(float(b))).otherwise(bound)
    h = calls.filter(F.col(latency).isNotNull()).groupBy(bound.alias("bucket")).agg(F.count("*").alias("count"))
    return h.withColumn("cumulative", F.sum("count").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)))


def histogram_percentile(histogram: DataFrame, p: float = 0.95) -> float | None:
    """The least bucket that holds a share of all calls."""
    total = histogram.agg(F.max("cumulative")).first()[0]
    if not total:
        return None
    return histogram.filter(F.col("cumulative") >= p * total).agg(F.min("bucket")).first()[0]


def model_stats(calls: DataFrame, model: str, ok: str, latency: str, tokens: str) -> DataFrame:
    """(model, calls, success_rate, mean and p95 latency, tokens)."""
    return calls.groupBy(F.col(model).alias("model")).agg(
        F.count("*").alias("calls"), F.round(F.avg(F.col(ok).cast("double")) * 100, 2).alias("success_rate"), F.round(F.avg(latency), 4).alias("avg_latency"), F.round(F.percentile(latency, F.lit(0.95)), 4).alias("p95_latency"), F.sum(tokens).alias("tokens")
    )


def error_rates(calls: DataFrame, ts: str, ok: str, window: str = "1 hour") -> DataFrame:
    return calls.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("calls"), F.count_if(~F.col(ok)).alias("errors")).select(F.col("w.start").alias("window_start"), "calls", "errors", F.round(F.col("errors") / F.col("calls") * 100, 4).alias("error_pct"))


def job_status(jobs: DataFrame, status: str = "status", created: str = "created_at", finished: str = "finished_at") -> DataFrame:
    took = F.unix_timestamp(finished) - F.unix_timestamp(created)
    return jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("jobs"), F.avg(took).alias("avg_seconds"), F.min(created).alias("oldest"))


def index_statistics(df: DataFrame, vector: str, cell: str | None = None) -> DataFrame:
    """Rows, null vectors, dimensions' extremes and, with cells, their count, largest and mean size."""
    base = df.agg(F.count("*").alias("rows"), F.count_if(F.col(vector).isNull()).alias("nulls"), F.min(F.size(vector)).alias("min_dims"), F.max(F.size(vector)).alias("max_dims"))
    if cell is None:
        return base
    sizes = df.groupBy(cell).count().agg(F.count("*").alias("cells"), F.max("count").alias("largest"), F.avg("count").alias("mean_size"))
    return base.crossJoin(sizes)  # one row each


def feedback(events: DataFrame, query_id: str, item: str, kind: str, weights: dict[str, float]) -> DataFrame:
    """(query, item, weight): summed weights of feedback kinds."""
    w = F.lit(0.0)
    for k, v in weights.items():
        w = F.when(F.col(kind) == k, F.lit(float(v))).otherwise(w)
    return events.groupBy(F.col(query_id).alias("query"), F.col(item).alias("item")).agg(F.sum(w).alias("weight"))
