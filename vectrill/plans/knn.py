"""Exact nearest-neighbour search."""

from __future__ import annotations

from vectrill.functions.vector import l2_distance
from pyspark.sql import functions as F

from vectrill.plans.registry import query, read

_Q = [round(((i * 37) % 64 - 31.5) / 256, 6) for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"


@query("knn_exact", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_QSQL}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_QSQL}), vec_id LIMIT 10")
def knn_exact(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    d = l2_distance(F.col("embedding").cast("array<double>"), F.array(*map(F.lit, _Q)))
    return e.select("vec_id", d.alias("d")).orderBy("d", "vec_id").limit(10).select("vec_id", F.round("d", 6).alias("distance"))
