"""Neighbour graphs, neighbourhood aggregation, tuning, importance, experiments and monitoring."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.functions import vector as V
from vectrill.operators import learn as L
from vectrill.operators.aggregates import vector_aggregate
from vectrill.operators.search import knn_batch

# ---- graphs of vectors


def knn_graph(df: DataFrame, vector: str, k: int = 5, *, id_col: str = "id", metric: str = "l2") -> DataFrame:
    """(src, dst, distance): each row's k nearest others, the queries in blocks."""
    near = knn_batch(df, vector, df, vector, k + 1, metric=metric, id_col=id_col, query_id=id_col).filter("query_id != id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("r", rank).filter(F.col("r") <= k).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "distance")


def neighbour_mean(edges: DataFrame, vectors: DataFrame, dims: int, *, id_col: str = "id", vector: str = "vector", own_weight: float = 0.0) -> DataFrame:
    """(node, n, vector): the mean of the out-neighbours' vectors, with a share of one's own. One layer
    of a graph convolution without its weights; nodes without neighbours keep their own."""
    v = vectors.select(F.col(id_col).alias("node"), V.vec(vector).alias("v"))
    got = edges.select("src", "dst").join(v.withColumnRenamed("node", "dst"), "dst")
    mean = vector_aggregate(got, "v", "avg", ["src"], dims, "m")
    both = v.join(mean.withColumnRenamed("src", "node"), "node", "left")
    mixed = F.zip_with("v", "m", lambda x, y: own_weight * x + (1 - own_weight) * y)
    return both.select("node", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(mixed, F.col("v")).alias("vector"))


def contains(a, b) -> Column:
    """Whether every element of b occurs in a."""
    return F.size(F.array_except(V.vec(b), V.vec(a))) == 0


def overlap(a, b) -> Column:
    return F.arrays_overlap(V.vec(a), V.vec(b))


def embedding_quality(df: DataFrame, vector: str, label: str, k: int = 10, *, id_col: str = "id") -> float:
    """Share of a row's k nearest others with its label, over all rows."""
    g = knn_graph(df, vector, k, id_col=id_col)
    a, b = (df.select(F.col(id_col).alias(c), F.col(label).alias(f"_{c}")) for c in ("src", "dst"))
    return g.join(a, "src").join(b, "dst").agg(F.avg((F.col("_src") == F.col("_dst")).cast("double"))).first()[0] or 0.0


# ---- tuning


def grid_search(algorithm: str, df: DataFrame, features: str, label: str, grid: dict[str, Sequence], *, n: int = 3, metric: str = "accuracy", task: str = "classification", id_col: str = "id") -> list[dict]:
    """Every combination's mean metric over folds, best first."""
    combos = [dict(zip(grid, c)) for c in itertools.product(*grid.values())]
    return _search(algorithm, df, features, label, combos, n, metric, task, id_col)


def random_search(algorithm: str, df: DataFrame, features: str, label: str, grid: dict[str, Sequence], trials: int = 5, *, seed: int = 42, n: int = 3, metric: str = "accuracy", task: str = "classification", id_col: str = "id") -> list[dict]:
    combos = [dict(zip(grid, c)) for c in itertools.product(*grid.values())]
    return _search(algorithm, df, features, label, random.Random(seed).sample(combos, min(trials, len(combos))), n, metric, task, id_col)


def _search(algorithm, df, features, label, combos, n, metric, task, id_col) -> list[dict]:
    out = []
    for p in combos:
        scores = [r[metric] for r in L.cross_validate(algorithm, df, features, label, n, p, id_col=id_col, task=task)]
        out.append({"params": p, metric: sum(scores) / len(scores)})
    return sorted(out, key=lambda r: -r[metric])


def ensemble(df: DataFrame, models: dict, features: str, name: str = "prediction") -> DataFrame:
    """df with the models' most frequent prediction, the smallest on ties."""
    d = df
    for i, m in enumerate(models.values()):
        d = L.predict(m, d, features, f"_p{i}")
    votes = F.array(*[F.col(f"_p{i}") for i in range(len(models))])
    count = F.transform(F.array_distinct(votes), lambda x: F.struct((-F.size(F.filter(votes, lambda y: y == x))).alias("n"), x.alias("v")))
    return d.withColumn(name, F.array_min(count)["v"]).select(*df.columns, name)


def permutation_importance(model, df: DataFrame, features: str, label: str, *, id_col: str = "id", task: str = "classification", metric: str = "accuracy", only: Sequence[int] | None = None) -> list[tuple[int, float]]:
    """(dimension, loss of the metric) when a dimension takes another row's value. The other row is
    the next in order of a hash within one of 64 hash groups."""
    base = L.evaluate(model, df, features, label, task)[metric]
    d = df.withColumn("_f", V.vec(features))
    dims = d.select(F.size("_f")).first()[0]
    h = F.xxhash64(F.col(id_col), F.lit("permute"))
    w = W.partitionBy(F.pmod(h, F.lit(64))).orderBy(h)
    d = d.withColumn("_next", F.coalesce(F.lead("_f").over(w), F.first("_f").over(w)))
    out = []
    for i in only if only is not None else range(dims):
        mixed = d.withColumn("_x", F.zip_with(F.arrays_zip(F.col("_f").alias("a"), F.col("_next").alias("b")), F.sequence(F.lit(0), F.lit(dims - 1)), lambda z, k: F.when(k == i, z["b"]).otherwise(z["a"])))
        out.append((i, base - L.evaluate(model, mixed, "_x", label, task)[metric]))
    return sorted(out, key=lambda r: (-r[1], r[0]))


# ---- experiments and monitoring


def assign_variant(key: Column | str, experiment: str, shares: Sequence[float]) -> Column:
    """A variant's number by a hash of the key and the experiment's name, in given shares."""
    unit = F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(experiment)), F.lit(1_000_000)) / 1e6
    out, upto = F.lit(len(shares) - 1), 1.0
    for i in range(len(shares) - 1, -1, -1):
        upto -= shares[i]
        out = F.when(unit < upto + shares[i], i).otherwise(out)
    return out


def ab_summary(df: DataFrame, variant: str, outcome: str) -> DataFrame:
    """(variant, n, mean, std, lift, z) against the smallest variant, which is the control."""
    g = df.groupBy(F.col(variant).alias("variant")).agg(F.count(outcome).alias("n"), F.avg(outcome).alias("mean"), F.stddev_samp(outcome).alias("std"))
    c = g.orderBy("variant").limit(1).select(F.col("n").alias("cn"), F.col("mean").alias("cm"), F.col("std").alias("cs"))
    x = g.crossJoin(F.broadcast(c))  # one row
    se = F.sqrt(F.col("std") ** 2 / F.col("n") + F.col("cs") ** 2 / F.col("cn"))
    return x.select("variant", "n", "mean", "std", (F.col("mean") / F.col("cm") - 1).alias("lift"), F.when(se > 0, (F.col("mean") - F.col("cm")) / se).otherwise(0.0).alias("z"))


def stability_index(base: DataFrame, current: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """(bucket, base_share, current_share, psi): how far a number's distribution moved over buckets."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        b = F.lit(0)
        for e in edges:
            b = b + (F.col(value) > float(e)).cast("int")
        n = df.filter(F.col(value).isNotNull()).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
        return n.select("bucket", F.col("n").alias(name), F.sum("n").over(W.partitionBy()).alias(f"{name}_all"))  # a row a bucket

    j = shares(base, "b").join(shares(current, "c"), "bucket", "full_outer")
    share = lambda x: F.greatest(F.coalesce(F.col(x) / F.col(f"{x}_all"), F.lit(0.0)), F.lit(1e-6))
    return j.select("bucket", share("b").alias("base_share"), share("c").alias("current_share"), ((share("c") - share("b")) * F.log(share("c") / share("b"))).alias("psi"))


def performance_by_window(df: DataFrame, ts: str, label: str, prediction: str, window: str = "1 day") -> DataFrame:
    """(window_start, n, accuracy) of logged predictions."""
    return df.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy")).select(F.col("w.start").alias("window_start"), "n", "accuracy")


def features_as_of(spine: DataFrame, features: DataFrame, key: str, ts: str, values: Sequence[str]) -> DataFrame:
    """spine with each feature's last value at or before its time, by one sort a key over both tables."""
    s = spine.select("*", F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_row"), *[F.lit(None).cast(dict(features.dtypes)[v]).alias(f"_{v}") for v in values])
    f = features.select(key, ts, F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    w = W.partitionBy(key).orderBy(ts, "_side", *[f"_{v}" for v in values]).rowsBetween(W.unboundedPreceding, 0)
    d = s.unionByName(f, allowMissingColumns=True)
    d = d.select(*spine.columns, "_side", *[F.last(F.col(f"_{v}"), ignorenulls=True).over(w).alias(v) for v in values])
    return d.filter("_side = 1").drop("_side")


def sentiment(text: Column | str, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """(positive - negative) / (positive + negative) of a text's words, 0 without any."""
    from vectrill.functions.text import tokens

    t = tokens(text)
    n = [_count(t, ws) for ws in (positive, negative)]
    return F.when(n[0] + n[1] > 0, (n[0] - n[1]) / (n[0] + n[1])).otherwise(0.0)


def _count(words: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(list(wanted))))


def sample_size(rate: float, lift: float, z: float = 1.96, power_z: float = 0.84) -> int:
    """Rows a variant needs to see a relative lift of a rate."""
    other = rate * (1 + lift)
    return math.ceil((z + power_z) ** 2 * (rate * (1 - rate) + other * (1 - other)) / (other - rate) ** 2)
