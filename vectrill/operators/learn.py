"""Supervised learning, clustering, dimension reduction and evaluation on DataFrames.

What has a closed form over sums (linear models, Gaussian naive Bayes) is computed from one
aggregation. Iterative learners are the JVM's own distributed ones. Features are vector
columns (arrays); ids and tables stay distributed, models are small.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import recommendation
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrill.functions import vector as V
from vectrill.operators import agglomerate
from vectrill.operators.lineage import cut
from vectrill.operators.search import knn

# ---- linear models by normal equations


@dataclass
class Linear:
    intercept: float
    coefficients: list[float]

    def predict(self, features: Column | str) -> Column:
        return F.lit(self.intercept) + V.inner_product(features, self.coefficients)


def gram(df: DataFrame, features: str, label: str) -> np.ndarray:
    """Sum of z z' for z = (1, features, label): a matrix product a batch, one narrow sum over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
                z = np.column_stack([np.ones(len(x)), x, b.column("y").to_numpy()])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.record_batch({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "v": pa.array(total.ravel())})

    d = df.select(V.vec(features).alias("x"), F.col(label).cast("double").alias("y")).dropna()
    rows = d.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not rows:
        raise ValueError("no rows to learn from")
    n = max(r["i"] for r in rows) + 1
    out = np.zeros((n, n))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def linear_regression(df: DataFrame, features: str, label: str, ridge: float = 1e-6) -> Linear:
    """Least squares with an intercept; a small ridge keeps it solvable, a larger one is tried where it isn't."""
    g = gram(df, features, label)
    a, b = g[:-1, :-1], g[:-1, -1]
    for extra in (0.0, 1e-3):
        try:
            w = np.linalg.solve(a + (ridge + extra) * np.eye(len(a)), b)
            return Linear(float(w[0]), w[1:].tolist())
        except np.linalg.LinAlgError:
            continue
    raise ValueError("the features are degenerate")


def ridge_regression(df: DataFrame, features: str, label: str, penalty: float = 1.0) -> Linear:
    """As linear_regression, the intercept left free."""
    g = gram(df, features, label)
    a, b = g[:-1, :-1], g[:-1, -1]
    p = penalty * np.eye(len(a))
    p[0, 0] = 0
    w = np.linalg.solve(a + p, b)
    return Linear(float(w[0]), w[1:].tolist())


def elastic_net(df: DataFrame, features: str, label: str, penalty: float = 0.1, l1_share: float = 0.5, rounds: int = 1000, tolerance: float = 1e-9) -> Linear:
    """Coordinate descent on the sums: 1/2n |y - Xw|^2 + penalty (l1_share |w| + (1 - l1_share) / 2 |w|^2)."""
    g = gram(df, features, label)
    n = g[0, 0]
    mean = g[0, 1:] / n
    c = g[1:, 1:] / n - np.outer(mean, mean)  # centred
    a, b, w = c[:-1, :-1], c[:-1, -1], np.zeros(len(c) - 1)
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(w)):
            r = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = np.sign(r) * max(abs(r) - penalty * l1_share, 0) / (a[j, j] + penalty * (1 - l1_share) + 1e-12)
        if np.abs(w - old).max() < tolerance:
            break
    return Linear(float(mean[-1] - mean[:-1] @ w), w.tolist())


def lasso_regression(df: DataFrame, features: str, label: str, penalty: float = 0.1, rounds: int = 1000) -> Linear:
    return elastic_net(df, features, label, penalty, 1.0, rounds)


# ---- naive Bayes


@dataclass
class GaussianNB:
    classes: list[int]
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]

    def scores(self, features: Column | str) -> list[Column]:
        """Log prior plus the sum of log(density + 1e-10), a class each."""
        out = []
        for p, m, v in zip(self.priors, self.means, self.variances):
            z = F.zip_with(V.vec(features), F.arrays_zip(V.vec(m).alias("m"), V.vec(v).alias("v")), lambda x, t: F.log(F.exp(-(x - t["m"]) * (x - t["m"]) / (2 * t["v"])) / F.sqrt(2 * np.pi * t["v"]) + 1e-10))
            out.append(F.lit(float(np.log(p))) + V.element_sum(z))
        return out

    def predict(self, features: Column | str) -> Column:
        """The class of the highest score, the smallest on ties."""
        s = self.scores(features)
        best = F.array_max(F.array(*s))
        out = F.lit(None).cast("int")
        for c, x in reversed(list(zip(self.classes, s))):
            out = F.when(x == best, F.lit(c)).otherwise(out)
        return out


def naive_bayes(df: DataFrame, features: str, label: str, floor: float = 1e-9) -> GaussianNB:
    """Priors, means and population variances (floored) of each class: one grouped pass."""
    d = df.filter(F.col(label).isNotNull() & F.col(features).isNotNull())
    dims = d.select(F.size(features)).first()[0]
    x = [F.get(F.col(features), F.lit(i)).cast("double") for i in range(dims)]
    rows = d.groupBy(F.col(label).cast("int").alias("c")).agg(F.count("*").alias("n"), *[F.avg(c) for c in x], *[F.var_pop(c) for c in x]).orderBy("c").collect()
    total = sum(r["n"] for r in rows)
    return GaussianNB([r["c"] for r in rows], [r["n"] / total for r in rows], [list(r[2 : dims + 2]) for r in rows], [[max(v, floor) for v in r[dims + 2 :]] for r in rows])


# ---- nearest neighbours


def knn_classify(df: DataFrame, features: str, label: str, query, k: int = 5, *, id_col: str = "id") -> int:
    """Majority label of the k nearest by L2, the smallest on ties."""
    near = knn(df, features, query, k, id_col=id_col, keep=[label])
    row = near.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).first()
    if row is None:
        raise ValueError("no rows to vote")
    return row[0]


def knn_regress(df: DataFrame, features: str, label: str, query, k: int = 5, *, id_col: str = "id") -> float:
    """Mean label of the k nearest by L2; fewer rows than k are an error."""
    n, mean = knn(df, features, query, k, id_col=id_col, keep=[label]).agg(F.count("*"), F.avg(label)).first()
    if n < k:
        raise ValueError("fewer rows than k")
    return mean


# ---- learners of the JVM library under one roof

ALGORITHMS = {
    "logistic_regression": ("classification", lambda p: C.LogisticRegression(maxIter=p.get("max_iters", 100), regParam=p.get("lambda", 0.001))),
    "svm": ("classification", lambda p: C.LinearSVC(maxIter=p.get("max_iters", 100), regParam=1.0 / max(p.get("C", 1.0) * 100, 1e-9))),
    "decision_tree": ("classification", lambda p: C.DecisionTreeClassifier(maxDepth=p.get("max_depth", 10), minInstancesPerNode=max(1, p.get("min_samples_split", 2) // 2), seed=p.get("seed", 42))),
    "random_forest": ("classification", lambda p: C.RandomForestClassifier(numTrees=p.get("n_trees", 100), maxDepth=p.get("max_depth", 10), seed=p.get("seed", 42))),
    "gradient_boosting": ("classification", lambda p: C.GBTClassifier(maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 5), stepSize=p.get("learning_rate", 0.1), seed=p.get("seed", 42))),
    "neural_network": ("classification", lambda p: C.MultilayerPerceptronClassifier(layers=p["layers"], maxIter=p.get("max_iters", 100), seed=p.get("seed", 42))),
    "random_forest_regressor": ("regression", lambda p: R.RandomForestRegressor(numTrees=p.get("n_trees", 100), maxDepth=p.get("max_depth", 10), seed=p.get("seed", 42))),
    "gradient_boosting_regressor": ("regression", lambda p: R.GBTRegressor(maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 5), stepSize=p.get("learning_rate", 0.1), seed=p.get("seed", 42))),
    "decision_tree_regressor": ("regression", lambda p: R.DecisionTreeRegressor(maxDepth=p.get("max_depth", 10), seed=p.get("seed", 42))),
}
#: The names of external boosting libraries stand for the same kind of model here.
for _name in ("xgboost", "catboost", "lightgbm"):
    ALGORITHMS[_name] = ALGORITHMS["gradient_boosting"]
    ALGORITHMS[f"{_name}_regressor"] = ALGORITHMS["gradient_boosting_regressor"]
OWN = {"linear_regression": linear_regression, "ridge": ridge_regression, "lasso": lasso_regression, "elastic_net": elastic_net, "naive_bayes": naive_bayes}


def list_algorithms() -> list[dict]:
    out = [{"algorithm": a, "category": kind, "supervised": True} for a, (kind, _) in ALGORITHMS.items()]
    out += [{"algorithm": a, "category": "classification" if a == "naive_bayes" else "regression", "supervised": True} for a in OWN]
    return out + [{"algorithm": a, "category": "clustering", "supervised": False} for a in ("kmeans", "minibatch_kmeans", "gmm", "dbscan", "hierarchical")]


def train(algorithm: str, df: DataFrame, features: str, label: str | None = None, params: dict | None = None):
    """A fitted model of any algorithm; predict() applies it."""
    p = params or {}
    if algorithm in OWN:
        return OWN[algorithm](df, features, label, **p)
    if algorithm in ("kmeans", "gmm"):
        return {"kmeans": kmeans, "gmm": gmm}[algorithm](df, features, **p)
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}")
    d = df.select(array_to_vector(V.vec(features)).alias("features"), F.col(label).cast("double").alias("label")).dropna()
    return ALGORITHMS[algorithm][1](p).fit(d)


def predict(model, df: DataFrame, features: str, name: str = "prediction") -> DataFrame:
    if isinstance(model, (Linear, GaussianNB)):
        return df.withColumn(name, model.predict(features).cast("double"))
    mid = df.withColumn("_features", array_to_vector(V.vec(features)))
    own = model.copy()
    own.setFeaturesCol("_features").setPredictionCol(name)
    for setter in ("setRawPredictionCol", "setProbabilityCol"):
        if hasattr(own, setter):
            getattr(own, setter)("_" + setter[3:])
    return own.transform(mid).select(*df.columns, F.col(name).cast("double").alias(name))


# ---- evaluation


def classification_metrics(df: DataFrame, label: str, prediction: str, positive: float = 1.0) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 of the positive class; 0 where undefined."""
    y, p = F.col(label) == positive, F.col(prediction) == positive
    c = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == F.col(prediction)).alias("ok"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    c = c.select("n", (F.col("ok") / F.when(F.col("n") > 0, F.col("n"))).alias("accuracy"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision"), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0).alias("recall"))
    return c.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: n, mse, rmse, mae, r_squared."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    return df.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v")).select("n", "mse", "rmse", "mae", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).otherwise(0.0).alias("r_squared"))


def evaluate(model, df: DataFrame, features: str, label: str, task: str = "classification") -> dict:
    d = predict(model, df, features, "_p")
    d = d.withColumn("_y", F.col(label).cast("double"))
    return (classification_metrics if task == "classification" else regression_metrics)(d, "_y", "_p").first().asDict()


def compare(models: dict, df: DataFrame, features: str, label: str, task: str = "classification") -> list[dict]:
    return [{"model": name} | evaluate(m, df, features, label, task) for name, m in models.items()]


def folds(df: DataFrame, n: int, *, id_col: str = "id") -> Column:
    """A row's fold by a hash of its id: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int")


def cross_validate(algorithm: str, df: DataFrame, features: str, label: str, n: int = 5, params: dict | None = None, *, id_col: str = "id", task: str = "classification") -> list[dict]:
    d = df.withColumn("_fold", folds(df, n, id_col=id_col))
    return [evaluate(train(algorithm, d.filter(F.col("_fold") != i), features, label, params), d.filter(F.col("_fold") == i), features, label, task) for i in range(n)]


def auto_train(df: DataFrame, features: str, label: str, task: str = "classification", metric: str | None = None, *, id_col: str = "id", algorithms: list[str] | None = None) -> tuple[str, object, list[dict]]:
    """(name, model, leaderboard): the best of several algorithms on a fifth held out by hash."""
    metric = metric or ("accuracy" if task == "classification" else "r_squared")
    names = algorithms or (["logistic_regression", "naive_bayes", "decision_tree"] if task == "classification" else ["linear_regression", "ridge", "decision_tree_regressor"])
    d = df.withColumn("_fold", folds(df, 5, id_col=id_col))
    fitted = {a: train(a, d.filter("_fold != 0"), features, label) for a in names}
    board = compare(fitted, d.filter("_fold = 0"), features, label, task)
    best = max(board, key=lambda r: r[metric])["model"]
    return best, fitted[best], sorted(board, key=lambda r: -r[metric])


# ---- clustering


def kmeans(df: DataFrame, features: str, k: int, max_iters: int = 100, seed: int = 42):
    d = df.select(array_to_vector(V.vec(features)).alias("features")).dropna()
    return K.KMeans(k=k, maxIter=max_iters, seed=seed, initMode="k-means||").fit(d)


def minibatch_kmeans(df: DataFrame, features: str, k: int, batch: int = 1000, rounds: int = 20, seed: int = 42) -> np.ndarray:
    """Centres by per-centre learning rates 1 / count over batches of a fixed size, taken by hash."""
    d = df.select(V.vec(features).alias("x")).dropna().withColumn("h", F.xxhash64("x", F.lit(seed)))
    x = np.array([r[0] for r in d.orderBy("h").limit(batch * rounds).select("x").collect()], float)
    if not len(x):
        return np.zeros((0, 0))
    c, n = x[: min(k, len(x))].copy(), np.zeros(min(k, len(x)))
    for i in range(0, len(x), batch):
        b = x[i : i + batch]
        for row, j in zip(b, ((b[:, None] - c) ** 2).sum(2).argmin(1)):
            n[j] += 1
            c[j] += (row - c[j]) / n[j]
    return c


def assign(df: DataFrame, features: str, centres, name: str = "cluster") -> DataFrame:
    """The nearest centre's number from 1, the smallest on ties."""
    c = np.array(centres, float)

    @F.pandas_udf("int")
    def near(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy())
        return pd.Series((((c**2).sum(1) - 2 * m @ c.T).argmin(1) + 1).astype("int32"))

    return df.withColumn(name, near(V.vec(features)))


def gmm(df: DataFrame, features: str, k: int, max_iters: int = 100, seed: int = 42):
    d = df.select(array_to_vector(V.vec(features)).alias("features")).dropna()
    return K.GaussianMixture(k=k, maxIter=max_iters, seed=seed).fit(d)


def _within_counts(left: pa.Table, right: pa.Table, pairs) -> Iterator[pa.RecordBatch]:
    """(id, n): how many of a tile's right rows are near each left row."""
    n = np.zeros(left.num_rows, np.int64)
    for i, _, _ in pairs:
        n += np.bincount(i, minlength=len(n))
    some = np.flatnonzero(n)
    yield pa.record_batch({"id": pa.array(left.column("id").to_numpy()[some]), "n": pa.array(n[some])})


def _within_links(left: pa.Table, right: pa.Table, pairs) -> Iterator[pa.RecordBatch]:
    """(border, a, b): each core row with the least of those that a tile links it to, and the border rows' core
    neighbours, of which a border row has fewer than a core row. The right rows are core rows."""
    ids, place = np.unique(np.r_[left.column("id").to_numpy(), right.column("id").to_numpy()], return_inverse=True)
    one, two, core = place[: left.num_rows], place[left.num_rows :], left.column("f").to_numpy() == 1
    up = np.arange(len(ids))

    def rows(border: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"border": pa.array(np.full(len(a), border)), "a": pa.array(ids[a]), "b": pa.array(ids[b])})

    for i, j, _ in pairs:
        inner = core[i]
        if not inner.all():
            yield rows(True, one[i[~inner]], two[j[~inner]])
        a, b = up[one[i[inner]]], up[two[j[inner]]]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up[up] != up).any():
                up = up[up]
            a, b = up[a], up[b]
    some = np.flatnonzero(up != np.arange(len(up)))
    yield rows(False, some, up[some])


def dbscan(df: DataFrame, features: str, eps: float, min_points: int = 5, *, id_col: str = "id") -> DataFrame:
    """(id, cluster): -1 is noise, clusters from 0 by their smallest id. Pairs within eps come from the tiles of
    the exact vector join, twice, and aren't kept: a tile passes on counts first, then which core rows it links,
    a row a row. Core points so linked are components; a border point takes its smallest core neighbour's cluster."""
    from pyspark.sql import Window as W

    from vectrill.operators import tiles
    from vectrill.operators.search import join_tiles

    d = cut(tiles.packed(df, features, id_col))
    counts = join_tiles(d, d, eps, _within_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    core = cut(counts.filter(F.col("n") >= min_points).select("id"))
    marked = cut(d.join(core.withColumn("f", F.lit(1)), "id", "left").select("id", "n", "v", F.coalesce("f", F.lit(0)).alias("f")))
    found = cut(join_tiles(marked, marked.filter("f = 1"), eps, _within_links, "border boolean, a long, b long"))
    ends = found.filter("NOT border").select("a", "b")
    inner = cut(ends.union(ends.select("b", "a")).distinct())
    label = core.withColumn("label", F.col("id"))
    while True:
        near = inner.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("other"))
        new = cut(label.join(near, "id", "left").select("id", F.least("label", "other").alias("label")))
        # a label's own label shortens chains
        new = cut(new.alias("a").join(new.select(F.col("id").alias("j"), F.col("label").alias("up")), F.col("a.label") == F.col("j")).select("id", F.col("up").alias("label")))
        same = new.alias("a").join(label.alias("b"), "id").filter("a.label != b.label").isEmpty()
        label = new
        if same:
            break
    border = found.filter("border").join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("label"))
    every = label.unionByName(border)
    names = label.select("label").distinct().withColumn("cluster", F.row_number().over(W.orderBy("label")) - 1)
    return d.select("id").join(every.join(F.broadcast(names), "label").select("id", "cluster"), "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def hierarchical(df: DataFrame, features: str, k: int, linkage: str = "average", *, id_col: str = "id", limit: int | None = None) -> DataFrame:
    """(id, cluster from 1 in order of their least ids) by agglomeration. Up to FINISH rows one task merges
    on a matrix; more rows are merged in rounds by all tasks. More rows than limit, if given, are an error."""
    n = df.count()
    if limit is not None and n > limit:
        raise ValueError(f"hierarchical clustering takes at most {limit} rows")
    if n > agglomerate.FINISH:
        d = df.select(F.col(id_col).cast("long").alias("id"), V.vec(features).alias("v")).dropna().toArrow().sort_by("id")
        x = d["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(d.num_rows, -1)
        group = agglomerate.agglomerate(df.sparkSession, x, k, linkage)
        _, name = np.unique(group, return_inverse=True)  # a cluster's name is its least row
        return df.sparkSession.createDataFrame(pa.table({"id": d["id"], "cluster": pa.array((name + 1).astype(np.int32))}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("id", ignore_index=True)
        if not len(rows):
            return
        x = np.stack(rows["v"])
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T, 0))
        np.fill_diagonal(d, np.inf)
        size, group, alive = np.ones(len(x)), np.arange(len(x)), len(x)
        while alive > max(k, 1):
            i, j = sorted(divmod(int(d.argmin()), len(x)))
            a, b = d[i], d[j]
            d[i] = {"single": np.minimum(a, b), "complete": np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b)), "average": (size[i] * a + size[j] * b) / (size[i] + size[j])}[linkage]
            d[:, i] = d[i]
            d[i, i] = np.inf
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            group[group == j] = i
            alive -= 1
        names = {g: n + 1 for n, g in enumerate(dict.fromkeys(group))}
        yield pd.DataFrame({"id": rows["id"], "cluster": [names[g] for g in group]})

    return df.select(F.col(id_col).cast("long").alias("id"), V.vec(features).alias("v")).dropna().coalesce(1).mapInPandas(run, "id long, cluster int")


def topics(df: DataFrame, features: str, text: str, k: int = 10, words: int = 5, seed: int = 42) -> DataFrame:
    """(topic from 1, n, terms): k-means over vectors, named by the words most over-represented."""
    from pyspark.sql import Window as W

    from vectrill.functions.text import tokens

    model = kmeans(df, features, k, seed=seed)
    d = predict(model, df.select(features, text), features, "topic").withColumn("topic", (F.col("topic") + 1).cast("int"))
    sizes = d.groupBy("topic").agg(F.count("*").alias("n"))
    w = d.select("topic", F.explode(F.array_distinct(tokens(text))).alias("w")).groupBy("topic", "w").agg(F.count("*").alias("c"))
    all_ = w.groupBy("w").agg(F.sum("c").alias("t"))
    s = w.join(all_, "w").join(F.broadcast(sizes), "topic").withColumn("s", F.col("c") / F.col("n") * F.log1p(F.col("c") / F.col("t")))
    top = s.withColumn("r", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("s"), "w"))).filter(F.col("r") <= words)
    return top.groupBy("topic").agg(F.max("n").alias("n"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"])).alias("terms"))


# ---- dimension reduction


def covariance(df: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    """(means, population covariance) from one pass of matrix products."""
    g = gram(df.withColumn("_zero", F.lit(0.0)), features, "_zero")[:-1, :-1]
    n = g[0, 0]
    mean = g[0, 1:] / n
    return mean, g[1:, 1:] / n - np.outer(mean, mean)


def project(df: DataFrame, features: str, mean: np.ndarray, basis: np.ndarray, name: str = "projected") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(((np.stack(v.to_numpy()) - mean) @ basis).tolist())

    return df.withColumn(name, run(V.vec(features)))


def pca(df: DataFrame, features: str, k: int, name: str = "projected") -> DataFrame:
    """Coordinates along the k directions of most variance; each direction's largest entry is positive."""
    mean, cov = covariance(df, features)
    val, vec = np.linalg.eigh(cov)
    basis = vec[:, np.argsort(-val)[:k]]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
    return project(df, features, mean, basis, name)


def whiten(df: DataFrame, features: str, epsilon: float = 1e-5, name: str = "whitened") -> DataFrame:
    mean, cov = covariance(df, features)
    val, vec = np.linalg.eigh(cov)
    return project(df, features, mean, vec / np.sqrt(np.maximum(val, 0) + epsilon) @ vec.T, name)


# ---- product quantization


def pq_train(df: DataFrame, features: str, parts: int = 8, codes: int = 256, sample: int = 20_000, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Codebooks (parts, codes, width): k-means a subspace on a bounded sample by hash."""
    x = np.array([r[0] for r in df.select(V.vec(features).alias("x")).dropna().orderBy(F.xxhash64("x", F.lit(seed))).limit(sample).collect()], float)
    width = x.shape[1] // parts
    books = []
    for p in range(parts):
        s = x[:, p * width : (p + 1) * width]
        c = s[: min(codes, len(s))].copy()
        for _ in range(rounds):
            near = ((s**2).sum(1)[:, None] - 2 * s @ c.T + (c**2).sum(1)).argmin(1)
            for j in np.unique(near):
                c[j] = s[near == j].mean(0)
        books.append(c)
    return np.array(books)


def pq_encode(df: DataFrame, features: str, books: np.ndarray, name: str = "codes") -> DataFrame:
    parts, _, width = books.shape

    @F.pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy())
        return pd.Series(np.stack([((books[p] ** 2).sum(1) - 2 * x[:, p * width : (p + 1) * width] @ books[p].T).argmin(1) for p in range(parts)], 1).tolist())

    return df.withColumn(name, run(V.vec(features)))


def pq_distance(codes: Column | str, query, books: np.ndarray) -> Column:
    """Asymmetric L2 distance of codes to a query, by table lookups."""
    parts, _, width = books.shape
    q = np.array(query, float)
    tables = [((books[p] - q[p * width : (p + 1) * width]) ** 2).sum(1).tolist() for p in range(parts)]
    c = F.col(codes) if isinstance(codes, str) else codes
    total = F.lit(0.0)
    for p, t in enumerate(tables):
        total = total + F.get(F.array(*map(F.lit, t)), F.get(c, F.lit(p)))
    return F.sqrt(total)


def opq_rotation(df: DataFrame, features: str, parts: int = 8) -> np.ndarray:
    """A rotation that spreads variance evenly over subspaces: principal axes dealt out by size."""
    _, cov = covariance(df, features)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)
    dims, load, slots = len(val), [0.0] * parts, [[] for _ in range(parts)]
    for i in order:
        free = [p for p in range(parts) if len(slots[p]) < dims // parts] or [0]
        p = min(free, key=lambda q: load[q])
        slots[p].append(i)
        load[p] += np.log(max(val[i], 1e-12))
    return vec[:, [i for s in slots for i in s]]


# ---- recommendation


def collaborative_filter(df: DataFrame, user: str, item: str, rating: str, factors: int = 10, iterations: int = 10, penalty: float = 0.1, seed: int = 42):
    return recommendation.ALS(userCol=user, itemCol=item, ratingCol=rating, rank=factors, maxIter=iterations, regParam=penalty, seed=seed, coldStartStrategy="drop").fit(df)


# ---- anomalies


def isolation_scores(df: DataFrame, features: str, trees: int = 50, sample: int = 256, *, id_col: str = "id", seed: int = 42) -> DataFrame:
    """(id, score): 2 ** (-mean depth / c(n)) over trees grown on hash samples of a fixed size."""
    x = np.array([r[0] for r in df.select(V.vec(features).alias("x")).dropna().orderBy(F.xxhash64("x", F.lit(seed))).limit(sample * 8).collect()], float)
    rng = np.random.default_rng(seed)

    def c(n: int) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(s: np.ndarray, depth: int, most: int):
        if depth >= most or len(s) <= 1:
            return c(len(s)) + depth
        j = int(rng.integers(s.shape[1]))
        lo, hi = s[:, j].min(), s[:, j].max()
        if lo == hi:
            return c(len(s)) + depth
        t = rng.uniform(lo, hi)
        return j, t, grow(s[s[:, j] < t], depth + 1, most), grow(s[s[:, j] >= t], depth + 1, most)

    size = min(sample, len(x))
    forest = [grow(x[rng.choice(len(x), size, replace=False)], 0, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if len(x) else []

    def walk(tree, m: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
        if isinstance(tree, tuple):
            left = m[at, tree[0]] < tree[1]
            walk(tree[2], m, out, at[left])
            walk(tree[3], m, out, at[~left])
        else:
            out[at] += tree

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy())
        depth = np.zeros(len(m))
        for t in forest:
            walk(t, m, depth, np.arange(len(m)))
        return pd.Series(2 ** (-depth / max(trees, 1) / max(c(size), 1e-9)))

    return df.select(F.col(id_col).alias("id"), V.vec(features).alias("x")).dropna().select("id", score("x").alias("score"))


def local_outlier_factor(df: DataFrame, features: str, k: int = 10, *, id_col: str = "id") -> DataFrame:
    """(id, score): the published factor, mean reachability density of neighbours over one's own."""
    from vectrill.operators.search import knn_batch

    near = knn_batch(df, features, df, features, k + 1, id_col=id_col, query_id=id_col).filter("query_id != id")
    near = cut(near)
    far = near.groupBy("query_id").agg(F.max("distance").alias("k_distance"))
    reach = near.join(far.select(F.col("query_id").alias("id"), "k_distance"), "id").withColumn("r", F.greatest("distance", "k_distance"))
    lrd = cut(reach.groupBy("query_id").agg((F.lit(1.0) / F.greatest(F.avg("r"), F.lit(1e-12))).alias("lrd")))
    own = near.join(lrd.select(F.col("query_id").alias("id"), F.col("lrd").alias("other")), "id").groupBy("query_id").agg(F.avg("other").alias("other"))
    return own.join(lrd, "query_id").select(F.col("query_id").alias("id"), (F.col("other") / F.col("lrd")).alias("score"))


def to_json(model) -> str:
    """A closed-form model's parameters."""
    return json.dumps({"kind": type(model).__name__} | asdict(model))


def from_json(text: str):
    d = json.loads(text)
    return {"Linear": Linear, "GaussianNB": GaussianNB}[d.pop("kind")](**d)
