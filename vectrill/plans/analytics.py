"""Statistics, graphs, series, learning and monitoring queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.operators import admin as A
from vectrill.operators import graph as G
from vectrill.operators import learn as L
from vectrill.operators import mlops as O
from vectrill.operators import search as S
from vectrill.operators import stats as X
from vectrill.operators import timeseries as TS
from vectrill.plans.registry import query, read
from vectrill.plans.searching import doc_vectors
from vectrill.plans.vectors import PROBE, PROBE_SQL, emb, r6

_E = "embedding::DOUBLE[]"
_MEAN = "(SELECT list(m ORDER BY p) AS mean FROM (SELECT p, avg(v) AS m FROM (SELECT unnest(range(1, 65)) AS p, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY p))"
_D = f"(SELECT vec_id AS id, list_distance({_E}, mean) AS d FROM embeddings, {_MEAN})"


@query("outliers_zscore", f"SELECT id, round((d - m) / s, 6) + 0.0 AS score, (d - m) / s > 1.5 AS is_outlier FROM {_D}, (SELECT avg(d) AS m, stddev_pop(d) AS s FROM {_D})")
def outliers_zscore(spark, sf_dir):
    return X.outliers(emb(spark, sf_dir), "embedding", "zscore", 1.5, id_col="vec_id").withColumn("score", r6(F.col("score")))


@query("outliers_mad", f"WITH d AS {_D}, m AS (SELECT median(d) AS med FROM d), a AS (SELECT median(abs(d - med)) AS mad FROM d, m) SELECT id, round(0.6745 * abs(d - med) / mad, 5) + 0.0 AS score, 0.6745 * abs(d - med) / mad > 2.0 AS is_outlier FROM d, m, a")
def outliers_mad(spark, sf_dir):
    return X.outliers(emb(spark, sf_dir), "embedding", "mad", 2.0, id_col="vec_id").withColumn("score", F.round("score", 5) + F.lit(0.0))


@query("outliers_iqr", f"WITH d AS {_D}, q AS (SELECT quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM d) SELECT id, round(greatest(q1 - d, d - q3, 0.0) / (q3 - q1), 5) + 0.0 AS score, greatest(q1 - d, d - q3, 0.0) / (q3 - q1) > 0.5 AS is_outlier FROM d, q")
def outliers_iqr(spark, sf_dir):
    return X.outliers(emb(spark, sf_dir), "embedding", "iqr", 0.5, id_col="vec_id").withColumn("score", F.round("score", 5) + F.lit(0.0))


def _stat(cond: str) -> str:
    return f"(SELECT p, avg(v) AS m, var_pop(v) AS s FROM (SELECT unnest(range(1, 65)) AS p, unnest({_E}) AS v FROM embeddings WHERE {cond}) GROUP BY p)"


@query("drift", f"SELECT round(sqrt(sum((c.m - b.m) * (c.m - b.m))), 6) + 0.0 AS distance, round(sqrt(sum((c.m - b.m) * (c.m - b.m))) / avg(sqrt(b.s)), 6) + 0.0 AS normalized, sqrt(sum((c.m - b.m) * (c.m - b.m))) / avg(sqrt(b.s)) > 3 AS significant, round(sum(0.5 * (ln(c.s / b.s) + b.s / c.s + (c.m - b.m) * (c.m - b.m) / c.s - 1)), 5) + 0.0 AS divergence FROM {_stat('label < 5')} b JOIN {_stat('label >= 5')} c USING (p)")
def drift(spark, sf_dir):
    e = emb(spark, sf_dir)
    base, cur = e.filter("label < 5"), e.filter("label >= 5")
    d = X.centroid_drift(base, cur, "embedding")
    return spark.createDataFrame([(round(d["distance"], 6), round(d["normalized"], 6), d["significant"], round(X.divergence(base, cur, "embedding"), 5))], "distance double, normalized double, significant boolean, divergence double")


@query("drift_by_day", "SELECT window_start, n, round(mean, 6) + 0.0 AS mean, round(abs(mean - m) / s, 5) + 0.0 AS drift FROM (SELECT date_trunc('day', ts) AS window_start, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1), (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def drift_by_day(spark, sf_dir):
    return X.drift_by_window(read(spark, sf_dir, "events"), "value", "ts").select("window_start", "n", r6(F.col("mean")).alias("mean"), (F.round("drift", 5) + F.lit(0.0)).alias("drift"))


@query(
    "davies_bouldin",
    f"""WITH c AS (SELECT label, list(m ORDER BY p) AS m FROM (SELECT label, p, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS p, unnest({_E}) AS v FROM embeddings) GROUP BY ALL) GROUP BY label),
    s AS (SELECT label, any_value(c.m) AS m, avg(list_distance({_E}, c.m)) AS s FROM embeddings JOIN c USING (label) GROUP BY label)
    SELECT round(avg(w), 5) + 0.0 AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.m, b.m)) AS w FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)""",
)
def davies_bouldin(spark, sf_dir):
    return spark.createDataFrame([(round(X.davies_bouldin(emb(spark, sf_dir), "embedding", "label"), 5),)], "davies_bouldin double")


@query("similarity_histogram")
def similarity_histogram(spark, sf_dir):
    """Pairs are picked by Spark's hash; tested against the same pairs."""
    return X.similarity_histogram(emb(spark, sf_dir), "embedding", 1000, id_col="vec_id")


# ---- graphs: a small made-up one of the nations that SQL can follow, customers and the parts they
# bought, and the nearest neighbours of all vectors

_EDGES = "(SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + k) % 25 AS dst FROM nation, (SELECT unnest([1, 3, 8]) AS k))"


def edges(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(8))).alias("k"))
    return n.select("src", ((F.col("src") * 7 + F.col("k")) % 25).alias("dst")).distinct()


def bought(spark, sf_dir):
    """Edges both ways between each customer (node 2 c_custkey) and each part it bought (2 p_partkey + 1)."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    e = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst")).dropna().distinct()
    return e.union(e.select("dst", "src"))


def near(spark, sf_dir):
    """Each vector's four nearest others."""
    return O.knn_graph(emb(spark, sf_dir), "embedding", 4, id_col="vec_id").select("src", "dst")


@query("graph_bfs", f"WITH RECURSIVE e AS {_EDGES}, r(node, depth) AS (SELECT 0, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 12), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT CAST(m.node AS BIGINT) AS node, CAST(m.depth AS INTEGER) AS depth, CAST(min(p.node) AS BIGINT) AS parent FROM m LEFT JOIN e ON dst = m.node LEFT JOIN m p ON p.node = src AND p.depth = m.depth - 1 GROUP BY m.node, m.depth")
def graph_bfs(spark, sf_dir):
    return G.bfs(edges(spark, sf_dir), 0)


_PR = "WITH e AS " + _EDGES + ", o AS (SELECT src, count(*) AS deg FROM e GROUP BY src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS s FROM n)" + "".join(
    f", r{i} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(x.v, 0) AS s FROM n LEFT JOIN (SELECT dst, sum(s / deg) AS v FROM e JOIN o USING (src) JOIN r{i - 1} r ON r.node = src GROUP BY dst) x ON x.dst = n.node)" for i in range(1, 6)
)


@query("graph_pagerank", _PR + " SELECT CAST(node AS BIGINT) AS node, round(s, 8) + 0.0 AS score FROM r5")
def graph_pagerank(spark, sf_dir):
    return G.pagerank(edges(spark, sf_dir), iterations=5, tolerance=0).select("node", (F.round("score", 8) + F.lit(0.0)).alias("score"))


@query("graph_communities")
def graph_communities(spark, sf_dir):
    """Iterative; tested against a plain loop."""
    return G.communities(bought(spark, sf_dir), 5)


@query("graph_dfs")
def graph_dfs(spark, sf_dir):
    """Serial; tested against a plain loop."""
    return G.dfs(bought(spark, sf_dir), 0)


@query("graph_bfs_orders")
def graph_bfs_orders(spark, sf_dir):
    """From customer 0, to any depth. Too large for SQL; tested against a plain loop."""
    return G.bfs(bought(spark, sf_dir), 0)


@query("graph_pagerank_orders")
def graph_pagerank_orders(spark, sf_dir):
    """Until no score changes by 1e-6, which SQL can't express."""
    return G.pagerank(bought(spark, sf_dir)).select("node", (F.round("score", 8) + F.lit(0.0)).alias("score"))


@query("graph_knn_vectors")
def graph_knn_vectors(spark, sf_dir):
    """Among all vectors that neighbours, either way, lead to from vector 0. Too slow in SQL."""
    e = near(spark, sf_dir)
    both = e.union(e.select("dst", "src")).distinct()
    return G.graph_knn(both, emb(spark, sf_dir), 0, PROBE, 5, -1, id_col="vec_id", vector="embedding").withColumn("distance", r6(F.col("distance")))


@query("graph_knn", f"WITH RECURSIVE e AS {_EDGES}, r(node, depth) AS (SELECT 0, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 2), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT CAST(node AS BIGINT) AS node, round(list_distance({_E}, {PROBE_SQL}), 6) + 0.0 AS distance, CAST(depth AS INTEGER) AS hops FROM m JOIN embeddings ON vec_id = node ORDER BY list_distance({_E}, {PROBE_SQL}), node LIMIT 5")
def graph_knn(spark, sf_dir):
    return G.graph_knn(edges(spark, sf_dir), emb(spark, sf_dir), 0, PROBE, 5, 2, id_col="vec_id", vector="embedding").withColumn("distance", r6(F.col("distance")))


# ---- series


def daily(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("value").alias("total"))


_DAY = "(SELECT date_trunc('day', ts) AS day, sum(value) AS total FROM events GROUP BY 1)"


@query("moving_average", f"SELECT day, round(total, 4) + 0.0 AS total, round(avg(total) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) + 0.0 AS moving_average FROM {_DAY}")
def moving_average(spark, sf_dir):
    d = TS.moving_average(daily(spark, sf_dir), "day", "total", 7)
    return d.select("day", (F.round("total", 4) + F.lit(0.0)).alias("total"), (F.round("moving_average", 4) + F.lit(0.0)).alias("moving_average"))


@query("arima", f"WITH x AS (SELECT total AS y, lag(total) OVER (ORDER BY day) AS x, day FROM {_DAY}), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x WHERE x IS NOT NULL), l AS (SELECT total AS y0 FROM {_DAY} ORDER BY day DESC LIMIT 1) SELECT CAST(k AS INTEGER) AS step, round(CASE k WHEN 1 THEN a + b * y0 WHEN 2 THEN a + b * (a + b * y0) ELSE a + b * (a + b * (a + b * y0)) END, 3) + 0.0 AS forecast FROM f, l, (SELECT unnest([1, 2, 3]) AS k)")
def arima(spark, sf_dir):
    """AR(1) of daily totals, three steps ahead."""
    model = TS.fit_ar(daily(spark, sf_dir), "day", "total", 1)
    return spark.createDataFrame([(i + 1, round(v, 3)) for i, v in enumerate(model.forecast(3))], "step int, forecast double")


@query("seasonal_decompose", f"WITH s AS (SELECT day, total, row_number() OVER (ORDER BY day) AS n, CASE WHEN count(*) OVER w = 7 THEN avg(total) OVER w END AS trend FROM {_DAY} WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), m AS (SELECT (n - 1) % 7 AS p, avg(total - trend) AS m FROM s GROUP BY 1), c AS (SELECT avg(m) AS c FROM m) SELECT day AS time, round(total, 3) + 0.0 AS value, round(trend, 3) + 0.0 AS trend, round(m - c, 3) + 0.0 AS seasonal, round(total - trend - (m - c), 3) + 0.0 AS residual FROM s JOIN m ON (n - 1) % 7 = p, c")
def seasonal_decompose(spark, sf_dir):
    d = TS.seasonal_decompose(daily(spark, sf_dir), "day", "total", 7)
    return d.select("time", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("value", "trend", "seasonal", "residual")])


# ---- learning


def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.array("l_quantity", "l_discount", "l_tax").alias("x3"))


@query("linear_regression", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 2) + 0.0 AS intercept, round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS slope, round(regr_r2(l_extendedprice, l_quantity), 5) + 0.0 AS r_squared FROM lineitem")
def linear_regression(spark, sf_dir):
    d = lines(spark, sf_dir)
    m = L.linear_regression(d, "x", "y")
    r2 = L.evaluate(m, d, "x", "y", "regression")["r_squared"]
    return spark.createDataFrame([(round(m.intercept, 2), round(m.coefficients[0], 3), round(r2, 5))], "intercept double, slope double, r_squared double")


@query("ridge_regression", "SELECT round(my - sxy / (sxx + 1000.0) * mx, 2) + 0.0 AS intercept, round(sxy / (sxx + 1000.0), 3) + 0.0 AS slope FROM (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem)")
def ridge_regression(spark, sf_dir):
    m = L.ridge_regression(lines(spark, sf_dir), "x", "y", 1000.0)
    return spark.createDataFrame([(round(m.intercept, 2), round(m.coefficients[0], 3))], "intercept double, slope double")


@query("lasso_regression", "SELECT round(my - w * mx, 2) + 0.0 AS intercept, round(w, 3) + 0.0 AS slope FROM (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, sign(covar_pop(l_extendedprice, l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity)) - 100.0, 0) / var_pop(l_quantity) AS w FROM lineitem)")
def lasso_regression(spark, sf_dir):
    m = L.lasso_regression(lines(spark, sf_dir), "x", "y", 100.0)
    return spark.createDataFrame([(round(m.intercept, 2), round(m.coefficients[0], 3))], "intercept double, slope double")


@query("elastic_net", "SELECT round(my - w * mx, 2) + 0.0 AS intercept, round(w, 3) + 0.0 AS slope FROM (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, sign(covar_pop(l_extendedprice, l_quantity)) * greatest(abs(covar_pop(l_extendedprice, l_quantity)) - 50.0, 0) / (var_pop(l_quantity) + 50.0) AS w FROM lineitem)")
def elastic_net(spark, sf_dir):
    m = L.elastic_net(lines(spark, sf_dir), "x", "y", 100.0, 0.5)
    return spark.createDataFrame([(round(m.intercept, 2), round(m.coefficients[0], 3))], "intercept double, slope double")


@query("naive_bayes_model", f"SELECT CAST(y AS INTEGER) AS class, CAST(p - 1 AS INTEGER) AS pos, round(n / total, 6) + 0.0 AS prior, round(avg(v), 6) + 0.0 AS mean, round(greatest(var_pop(v), 1e-9), 6) + 0.0 AS variance FROM (SELECT label % 2 AS y, unnest(range(1, 65)) AS p, unnest({_E}) AS v FROM embeddings), (SELECT label % 2 AS y2, count(*) AS n FROM embeddings GROUP BY 1), (SELECT count(*)::DOUBLE AS total FROM embeddings) WHERE y = y2 GROUP BY y, p, n, total")
def naive_bayes_model(spark, sf_dir):
    m = L.naive_bayes(emb(spark, sf_dir).withColumn("y", F.col("label") % 2), "embedding", "y")
    rows = [(c, i, round(p, 6), round(a, 6), round(b, 6)) for c, p, ms, vs in zip(m.classes, m.priors, m.means, m.variances) for i, (a, b) in enumerate(zip(ms, vs))]
    return spark.createDataFrame(rows, "class int, pos int, prior double, mean double, variance double")


_ST = f"(SELECT y, list(m ORDER BY p) AS m, list(s ORDER BY p) AS s FROM (SELECT label % 2 AS y, p, avg(v) AS m, greatest(var_pop(v), 1e-9) AS s FROM (SELECT label, unnest(range(1, 65)) AS p, unnest({_E}) AS v FROM embeddings) GROUP BY ALL) GROUP BY y)"


@query(
    "naive_bayes_predict",
    f"""WITH z AS (SELECT vec_id, y, ln(n / total) + list_sum(list_transform(list_zip({_E}, m, s), lambda t: ln(exp(-(t[1]-t[2])*(t[1]-t[2]) / (2 * t[3])) / sqrt(2 * pi() * t[3]) + 1e-10))) AS score FROM embeddings, {_ST} JOIN (SELECT label % 2 AS y, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1) USING (y), (SELECT count(*) AS total FROM embeddings))
    SELECT vec_id, CAST(min(y) AS DOUBLE) AS prediction FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS best FROM z) WHERE score = best GROUP BY vec_id""",
)
def naive_bayes_predict(spark, sf_dir):
    d = emb(spark, sf_dir).withColumn("y", F.col("label") % 2)
    return L.predict(L.naive_bayes(d, "embedding", "y"), d, "embedding").select("vec_id", "prediction")


@query("knn_vote", f"WITH n AS (SELECT label FROM embeddings ORDER BY list_distance({_E}, {PROBE_SQL}), vec_id LIMIT 15) SELECT CAST((SELECT label FROM n GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS INTEGER) AS class, (SELECT round(avg(label), 6) + 0.0 FROM n) AS mean_label")
def knn_vote(spark, sf_dir):
    e = emb(spark, sf_dir)
    return spark.createDataFrame([(int(L.knn_classify(e, "embedding", "label", PROBE, 15, id_col="vec_id")), round(L.knn_regress(e, "embedding", "label", PROBE, 15, id_col="vec_id"), 6))], "class int, mean_label double")


@query("classification_metrics", "WITH x AS (SELECT label % 2 AS y, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE label % 2 END AS p FROM embeddings), c AS (SELECT count(*) AS n, count(*) FILTER (y = p)::DOUBLE AS ok, count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (p = 1)::DOUBLE AS pp, count(*) FILTER (y = 1)::DOUBLE AS yy FROM x) SELECT n, round(ok / n, 6) AS accuracy, round(tp / pp, 6) AS precision, round(tp / yy, 6) AS recall, round(2 * (tp / pp) * (tp / yy) / (tp / pp + tp / yy), 6) AS f1 FROM c")
def classification_metrics(spark, sf_dir):
    d = emb(spark, sf_dir).select((F.col("label") % 2).alias("y"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(F.col("label") % 2).alias("p"))
    m = L.classification_metrics(d, "y", "p")
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def binary(spark, sf_dir):
    return emb(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("int"))


def _fitted(algorithm: str, params: dict):
    def run(spark, sf_dir):
        d = binary(spark, sf_dir)
        return L.predict(L.train(algorithm, d, "embedding", "y", params), d, "embedding").select("vec_id", "prediction")

    return run


for _name, _params in {"logistic_regression": {}, "svm": {}, "decision_tree": {"max_depth": 4}, "random_forest": {"n_trees": 10, "max_depth": 4}, "gradient_boosting": {"n_estimators": 5, "max_depth": 3}, "neural_network": {"layers": [64, 8, 2], "max_iters": 30}}.items():
    query(f"train_{_name}")(_fitted(_name, _params))


@query("cluster_kmeans")
def cluster_kmeans(spark, sf_dir):
    e = emb(spark, sf_dir)
    return L.predict(L.kmeans(e, "embedding", 8, 20), e, "embedding", "cluster").select("vec_id", (F.col("cluster") + 1).cast("int").alias("cluster"))


@query("cluster_minibatch")
def cluster_minibatch(spark, sf_dir):
    e = emb(spark, sf_dir)
    return L.assign(e, "embedding", L.minibatch_kmeans(e, "embedding", 8, 100, 5)).select("vec_id", "cluster")


@query("cluster_gmm")
def cluster_gmm(spark, sf_dir):
    d = L.pca(emb(spark, sf_dir), "embedding", 4)
    return L.predict(L.gmm(d, "projected", 4, 10), d, "projected", "cluster").select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@query("cluster_dbscan")
def cluster_dbscan(spark, sf_dir):
    return L.dbscan(emb(spark, sf_dir), "embedding", 1.1, 4, id_col="vec_id")


@query("cluster_hierarchical")
def cluster_hierarchical(spark, sf_dir):
    return L.hierarchical(emb(spark, sf_dir), "embedding", 5, id_col="vec_id")


@query("topics")
def topics(spark, sf_dir):
    return L.topics(doc_vectors(spark, sf_dir), "embedding", "text", 5)


@query("reduce_pca")
def reduce_pca(spark, sf_dir):
    """Rotations have no SQL; variance and orthogonality are tested."""
    d = L.pca(emb(spark, sf_dir), "embedding", 3)
    return d.select("vec_id", *[r6(F.get("projected", F.lit(i))).alias(f"c{i}") for i in range(3)])


@query("whiten")
def whiten(spark, sf_dir):
    return L.whiten(emb(spark, sf_dir), "embedding").select("vec_id", r6(F.get("whitened", F.lit(0))).alias("first"))


@query("product_quantization")
def product_quantization(spark, sf_dir):
    e = emb(spark, sf_dir)
    books = L.pq_train(e, "embedding", 8, 16)
    return L.pq_encode(e, "embedding", books).select("vec_id", r6(L.pq_distance("codes", PROBE, books)).alias("distance")).orderBy("distance", "vec_id").limit(20)


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    return L.isolation_scores(emb(spark, sf_dir), "embedding", 20, 128, id_col="vec_id").withColumn("score", r6(F.col("score")))


@query("local_outlier_factor")
def local_outlier_factor(spark, sf_dir):
    return L.local_outlier_factor(emb(spark, sf_dir), "embedding", 10, id_col="vec_id").withColumn("score", r6(F.col("score")))


@query("recommender")
def recommender(spark, sf_dir):
    r = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(F.avg("l_quantity").cast("float").alias("rating"))
    m = L.collaborative_filter(r, "user", "item", "rating", 4, 3)
    return m.transform(r).select("user", "item", F.round("prediction", 4).cast("double").alias("prediction"))


@query("auto_train")
def auto_train(spark, sf_dir):
    _, _, board = L.auto_train(binary(spark, sf_dir), "embedding", "y", id_col="vec_id", algorithms=["naive_bayes", "logistic_regression"])
    return spark.createDataFrame([(b["model"], float(b["accuracy"])) for b in board], "model string, accuracy double")


# ---- monitoring


def calls(spark, sf_dir):
    return read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("model"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"), (F.col("user_id") % 100).alias("tokens"))


_CALLS = "(SELECT ts, event_type AS model, event_type <> 'error' AS ok, value AS latency, user_id % 100 AS tokens FROM events)"
BUCKETS = [10.0, 25.0, 50.0, 100.0, 250.0]


@query("model_stats", f"SELECT model, count(*) AS calls, round(avg(ok::INT::DOUBLE) * 100, 2) AS success_rate, round(avg(latency), 4) AS avg_latency, round(quantile_cont(latency, 0.95), 4) AS p95_latency, CAST(sum(tokens) AS BIGINT) AS tokens FROM {_CALLS} GROUP BY model")
def model_stats(spark, sf_dir):
    return A.model_stats(calls(spark, sf_dir), "model", "ok", "latency", "tokens")


@query("error_rates", f"SELECT date_trunc('hour', ts) AS window_start, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, round(count(*) FILTER (NOT ok) / count(*) * 100, 4) AS error_pct FROM {_CALLS} GROUP BY 1")
def error_rates(spark, sf_dir):
    return A.error_rates(calls(spark, sf_dir), "ts", "ok")


_CASE = " ".join(f"WHEN latency <= {b} THEN {b}::DOUBLE" for b in BUCKETS)


@query("latency_histogram", f"SELECT bucket, count, CAST(sum(count) OVER (ORDER BY bucket) AS BIGINT) AS cumulative FROM (SELECT CASE {_CASE} ELSE 'infinity'::DOUBLE END AS bucket, count(*) AS count FROM {_CALLS} GROUP BY 1)")
def latency_histogram(spark, sf_dir):
    return A.latency_histogram(calls(spark, sf_dir), "latency", BUCKETS)


@query("quota_usage", "WITH u AS (SELECT n_regionkey AS tenant_id, count(*) AS vectors, sum(c_custkey) AS storage_bytes, count(*) // 10 AS qps FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), q AS (SELECT r_regionkey AS tenant_id, 280 AS max_vectors, 200000 AS max_storage, 1000 AS max_qps FROM region WHERE r_regionkey < 4) SELECT CAST(tenant_id AS INTEGER) AS tenant_id, vectors, round(vectors / max_vectors * 100, 2) AS vector_usage_pct, round(storage_bytes / max_storage * 100, 2) AS storage_usage_pct, coalesce(vectors > max_vectors, false) OR coalesce(storage_bytes > max_storage, false) OR coalesce(qps > max_qps, false) AS exceeded FROM u LEFT JOIN q USING (tenant_id)")
def quota_usage(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    u = c.groupBy(F.col("n_regionkey").alias("tenant_id")).agg(F.count("*").alias("vectors"), F.sum("c_custkey").alias("storage_bytes"), F.floor(F.count("*") / 10).alias("qps"))
    q = read(spark, sf_dir, "region").filter("r_regionkey < 4").select(F.col("r_regionkey").alias("tenant_id"), F.lit(280).alias("max_vectors"), F.lit(200000).alias("max_storage"), F.lit(1000).alias("max_qps"))
    return A.quota_usage(u, q).select("tenant_id", "vectors", "vector_usage_pct", "storage_usage_pct", "exceeded")


@query("index_statistics", "SELECT count(*) AS rows, count(*) FILTER (embedding IS NULL) AS nulls, CAST(min(len(embedding)) AS INTEGER) AS min_dims, CAST(max(len(embedding)) AS INTEGER) AS max_dims, (SELECT count(DISTINCT label) FROM embeddings) AS cells, (SELECT max(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)) AS largest, round((SELECT avg(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)), 6) AS mean_size FROM embeddings")
def index_statistics(spark, sf_dir):
    return A.index_statistics(emb(spark, sf_dir), "embedding", "label").withColumn("mean_size", F.round("mean_size", 6))


@query("feedback", "SELECT user_id AS query, event_type AS item, CAST(sum(CASE event_type WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 5.0 ELSE 0.0 END) AS DOUBLE) AS weight FROM events GROUP BY ALL")
def feedback(spark, sf_dir):
    return A.feedback(read(spark, sf_dir, "events"), "user_id", "event_type", "event_type", {"click": 1.0, "purchase": 5.0})


@query("time_travel", "SELECT event_id, event_type FROM (SELECT event_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events) WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
def time_travel(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("valid_from", F.col("ts")).withColumn("valid_to", F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return S.time_travel(e, "2024-01-15 00:00:00").select("event_id", "event_type")
