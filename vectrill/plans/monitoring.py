"""Neighbour graphs, experiments, monitoring and feature lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrill.operators import mlops as O
from vectrill.plans.analytics import _EDGES, edges, near
from vectrill.plans.registry import query, read
from vectrill.plans.vectors import emb, r6

_E = "embedding::DOUBLE[]"


@query("knn_graph", f"SELECT src, dst, round(d, 5) + 0.0 AS distance FROM (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.{_E}, b.{_E}) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.{_E}, b.{_E}), 7), b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= 4")
def knn_graph(spark, sf_dir):
    return O.knn_graph(emb(spark, sf_dir), "embedding", 4, id_col="vec_id").withColumn("distance", F.round("distance", 5) + F.lit(0.0))


@query("neighbour_mean", f"WITH e AS {_EDGES}, m AS (SELECT src, count(*) AS n, avg(embedding[1]::DOUBLE) AS a, avg(embedding[64]::DOUBLE) AS z FROM e JOIN embeddings ON vec_id = dst GROUP BY src) SELECT vec_id AS node, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(a, embedding[1]::DOUBLE), 6) + 0.0 AS first, round(coalesce(z, embedding[64]::DOUBLE), 6) + 0.0 AS last FROM embeddings LEFT JOIN m ON src = vec_id")
def neighbour_mean(spark, sf_dir):
    v = emb(spark, sf_dir)
    d = O.neighbour_mean(edges(spark, sf_dir), v, 64, id_col="vec_id", vector="embedding")
    return d.select("node", "n", r6(F.element_at("vector", 1)).alias("first"), r6(F.element_at("vector", -1)).alias("last"))


@query("neighbour_mean_vectors")
def neighbour_mean_vectors(spark, sf_dir):
    """Over the nearest neighbours of every vector; too slow in SQL."""
    d = O.neighbour_mean(near(spark, sf_dir), emb(spark, sf_dir), 64, id_col="vec_id", vector="embedding")
    return d.select("node", "n", r6(F.element_at("vector", 1)).alias("first"), r6(F.element_at("vector", -1)).alias("last"))


@query("ab_test", "WITH g AS (SELECT user_id % 3 AS variant, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1), c AS (SELECT n AS cn, m AS cm, s AS cs FROM g ORDER BY variant LIMIT 1) SELECT variant, n, round(m, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS std, round(m / cm - 1, 6) + 0.0 AS lift, round((m - cm) / sqrt(s * s / n + cs * cs / cn), 6) + 0.0 AS z FROM g, c")
def ab_test(spark, sf_dir):
    d = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("variant"), "value")
    return O.ab_summary(d, "variant", "value").select("variant", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "lift", "z")])


_B = "(value > 10)::INT + (value > 25)::INT + (value > 50)::INT + (value > 100)::INT"


@query("stability_index", f"WITH b AS (SELECT {_B} AS bucket, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), c AS (SELECT {_B} AS bucket, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1), s AS (SELECT coalesce(b.bucket, c.bucket) AS bucket, greatest(coalesce(b.n / (SELECT sum(n) FROM b), 0), 1e-6) AS p, greatest(coalesce(c.n / (SELECT sum(n) FROM c), 0), 1e-6) AS q FROM b FULL JOIN c ON b.bucket = c.bucket) SELECT CAST(bucket AS INTEGER) AS bucket, round(p, 6) + 0.0 AS base_share, round(q, 6) + 0.0 AS current_share, round((q - p) * ln(q / p), 8) + 0.0 AS psi FROM s")
def stability_index(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    d = O.stability_index(e.filter("ts < TIMESTAMP '2024-01-15'"), e.filter("ts >= TIMESTAMP '2024-01-15'"), "value", [10, 25, 50, 100])
    return d.select("bucket", r6(F.col("base_share")).alias("base_share"), r6(F.col("current_share")).alias("current_share"), (F.round("psi", 8) + F.lit(0.0)).alias("psi"))


@query("model_performance", "SELECT date_trunc('day', ts) AS window_start, count(*) AS n, round(avg(CASE WHEN user_id % 2 = event_id % 2 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM events GROUP BY 1")
def model_performance(spark, sf_dir):
    d = read(spark, sf_dir, "events").select("ts", (F.col("user_id") % 2).alias("y"), (F.col("event_id") % 2).alias("p"))
    return O.performance_by_window(d, "ts", "y", "p").withColumn("accuracy", r6(F.col("accuracy")))


@query("features_as_of", "SELECT p.event_id, c.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) c ON p.user_id = c.user_id AND c.ts <= p.ts")
def features_as_of(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    spine = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return O.features_as_of(spine, e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view")), "user_id", "ts", ["last_view"]).select("event_id", "last_view")


@query("sentiment", "SELECT doc_id, round(CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n) END, 6) + 0.0 AS score FROM (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the', 'and'))) AS p, len(list_filter(w, lambda x: x IN ('idiot', 'trash', 'of'))) AS n FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents))")
def sentiment(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", r6(O.sentiment("text", ["the", "and"], ["idiot", "trash", "of"])).alias("score"))
