"""Outliers, drift, cluster quality and similarity statistics over vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrill.functions import vector as V


def moments(df: DataFrame, vector: str, dims: int | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(count, means, population variances) of each dimension: one pass, one row to the driver."""
    if dims is None:
        first = df.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
        dims = first[0] if first else 0
    x = [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(dims)]
    row = df.agg(F.count(vector), *[F.avg(c) for c in x], *[F.var_pop(c) for c in x]).first()
    return row[0], np.array(row[1 : dims + 1], float), np.array(row[dims + 1 :], float)


def outliers(df: DataFrame, vector: str, method: str = "zscore", threshold: float | None = None, *, id_col: str = "id") -> DataFrame:
    """(id, score, is_outlier) by the L2 distance from the mean vector.

    zscore: (d - mean) / population deviation, over 3. mad: 0.6745 |d - median| / MAD, over 3.5;
    a MAD under 1e-10 counts as 1. iqr: how many ranges d lies outside the quartiles, over 1.5.
    The table's figures are a few sums; nothing is shuffled but those.
    """
    _, mean, _ = moments(df, vector)
    d = df.select(F.col(id_col).alias("id"), V.l2_distance(vector, mean.tolist()).alias("d")).filter("d IS NOT NULL")
    if method == "zscore":
        m, s = d.agg(F.avg("d"), F.stddev_pop("d")).first()
        score = (F.col("d") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        t = 3.0
    elif method == "mad":
        med = d.agg(F.percentile("d", F.lit(0.5))).first()[0]
        mad = d.agg(F.percentile(F.abs(F.col("d") - F.lit(med)), F.lit(0.5))).first()[0] or 0.0
        score, t = 0.6745 * F.abs(F.col("d") - F.lit(med)) / (mad if mad >= 1e-10 else 1.0), 3.5
    elif method == "iqr":
        q1, q3 = d.agg(F.percentile("d", F.lit(0.25)), F.percentile("d", F.lit(0.75))).first()
        gap = (q3 or 0) - (q1 or 0)
        score, t = F.greatest(F.lit(q1) - F.col("d"), F.col("d") - F.lit(q3), F.lit(0.0)) / (gap if gap > 1e-10 else 1.0), 1.5
    else:
        raise ValueError(f"unknown method {method}")
    return d.select("id", score.alias("score"), (score > (t if threshold is None else threshold)).alias("is_outlier"))


def centroid_drift(base: DataFrame, current: DataFrame, vector: str, threshold: float = 3.0) -> dict:
    """L2 between the means over the base's mean deviation; each side needs ten rows."""
    (n, mb, vb), (m, mc, _) = moments(base, vector), moments(current, vector)
    if min(n, m) < 10:
        raise ValueError("each side needs at least 10 vectors")
    gap, spread = float(np.linalg.norm(mc - mb)), float(np.sqrt(np.maximum(vb, 0)).mean())
    drift = gap / spread if spread > 1e-10 else 0.0
    return {"distance": gap, "normalized": drift, "significant": drift > threshold}


def divergence(base: DataFrame, current: DataFrame, vector: str) -> float:
    """KL divergence between diagonal Gaussians; dimensions with variance under 1e-10 are left out."""
    (_, mb, vb), (_, mc, vc) = moments(base, vector), moments(current, vector)
    ok = (vb >= 1e-10) & (vc >= 1e-10)
    mb, vb, mc, vc = mb[ok], vb[ok], mc[ok], vc[ok]
    return float((0.5 * (np.log(vc / vb) + vb / vc + (mc - mb) ** 2 / vc - 1)).sum())


def drift_by_window(df: DataFrame, value: str, ts: str, window: str = "1 day") -> DataFrame:
    """(window_start, n, mean, drift) of a number: each window's mean against the whole's, in deviations."""
    whole = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    w = df.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return w.crossJoin(F.broadcast(whole)).select(F.col("w.start").alias("window_start"), "n", "mean", (F.abs(F.col("mean") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("drift"))


def centroids(df: DataFrame, vector: str, cluster: str, dims: int | None = None) -> list[tuple]:
    """(cluster, size, mean vector) of each cluster, which are few."""
    if dims is None:
        dims = df.select(F.size(vector)).first()[0]
    rows = df.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), *[F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(dims)]).orderBy("c").collect()
    return [(r[0], r[1], np.array(r[2:], float)) for r in rows]


def davies_bouldin(df: DataFrame, vector: str, cluster: str) -> float:
    """Mean of the worst (scatter + scatter) / gap a cluster; clusters of fewer than two rows are skipped."""
    cs = [c for c in centroids(df, vector, cluster) if c[1] >= 2]
    if len(cs) < 2:
        return 0.0
    own: Column = F.lit(None).cast("array<double>")
    for c, _, m in cs:
        own = F.when(F.col(cluster) == c, V.vec(m.tolist())).otherwise(own)
    s = {r[0]: r[1] for r in df.groupBy(F.col(cluster).alias("c")).agg(F.avg(V.l2_distance(V.vec(vector), own))).collect()}
    total = 0.0
    for c, _, m in cs:
        worst = [(s[c] + s[o]) / g for o, _, q in cs if o != c and (g := float(np.linalg.norm(m - q))) > 1e-10]
        total += max(worst, default=0.0)
    return total / len(cs)


def similarity_histogram(df: DataFrame, vector: str, pairs: int = 1000, *, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Statistics of cosine similarity over seeded pairs: each of about `pairs` rows with the next by hash."""
    n = df.count()
    d = df.select(F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"), V.vec(vector).alias("v")).filter("v IS NOT NULL")
    share = min(1.0, pairs / max(n, 1))
    d = d.filter(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("h").limit(2 * pairs + 2)  # bounded
    from pyspark.sql import Window as W

    x = d.withColumn("next", F.lead("v").over(W.orderBy("h"))).filter("next IS NOT NULL").select((1 - V.cosine_distance("v", "next")).alias("s"))
    return x.agg(F.count("*").alias("n"), F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), *[F.percentile("s", F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95, 99)])
