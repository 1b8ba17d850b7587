"""Neighbour graphs, tuning, importance and experiments."""

import numpy as np
from pyspark.sql import functions as F

from vectrill.operators import learn as L
from vectrill.operators import mlops as O


def test_mlops(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (-2, 2)])
    df = spark.createDataFrame([(i, v.tolist(), i // 40) for i, v in enumerate(x)], "id long, v array<double>, y int").cache()
    d = np.linalg.norm(x[:, None] - x, axis=2)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in O.knn_graph(df, "v", 3).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    assert got == {i: set(np.argsort(d[i])[:3].tolist()) for i in range(80)}
    assert O.embedding_quality(df, "v", "y", 3) == 1.0
    board = O.grid_search("decision_tree", df, "v", "y", {"max_depth": [1, 2]}, n=2)
    assert len(board) == 2 and board[0]["accuracy"] > 0.9
    assert len(O.random_search("decision_tree", df, "v", "y", {"max_depth": [1, 2, 3]}, 1, n=2)) == 1
    noise = df.withColumn("v", F.concat("v", F.array(F.lit(0.5))))
    m = L.naive_bayes(noise, "v", "y", 1e-3)
    imp = dict(O.permutation_importance(m, noise, "v", "y"))
    assert imp[3] == 0 and max(imp.values()) >= 0
    models = {"a": m, "b": L.train("decision_tree", noise, "v", "y"), "c": L.train("logistic_regression", noise, "v", "y")}
    assert L.classification_metrics(O.ensemble(noise, models, "v"), "y", "prediction").first()["accuracy"] > 0.95


def test_variants(spark):
    d = spark.range(20_000).withColumn("k", O.assign_variant("id", "exp", [0.2, 0.3, 0.5]))
    n = {r["k"]: r["count"] / 20_000 for r in d.groupBy("k").count().collect()}
    assert all(abs(n[i] - s) < 0.02 for i, s in enumerate([0.2, 0.3, 0.5]))
    assert O.sample_size(0.1, 0.1) > O.sample_size(0.1, 0.5)


def test_sets(spark):
    a = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = spark.range(1).select(O.contains(a, [1.0, 3.0]), O.contains(a, [4.0]), O.overlap(a, [4.0, 1.0])).first()
    assert list(r) == [True, False, True]
