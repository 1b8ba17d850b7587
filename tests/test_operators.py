"""Operators without SQL, against brute force; and edge cases of the others."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrill.catalog import Catalog
from vectrill.operators import admin as A
from vectrill.operators import graph as G
from vectrill.operators import learn as L
from vectrill.operators import rerank as R
from vectrill.operators import search as S
from vectrill.operators import stats as X
from vectrill.operators import timeseries as TS
from vectrill.operators.aggregates import vector_aggregate
from vectrill.sources import io


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 4)) for c in (-2, 0, 2)])
    return x, spark.createDataFrame([(i, v.tolist(), i // 40) for i, v in enumerate(x)], "id long, v array<double>, label int").cache()


def test_knn_batch_and_ivf(points):
    x, df = points
    got = {(r["query_id"], r["rank"]): r["id"] for r in S.knn_batch(df, "v", df.filter("id % 10 = 0"), "v", 3, block=5).collect()}
    for q in range(0, 120, 10):
        order = np.lexsort((np.arange(120), np.round(np.linalg.norm(x - x[q], axis=1), 9)))[:3]
        assert [got[q, r] for r in (1, 2, 3)] == order.tolist()
    c, index = S.ivf_build(df, "v", 6)
    hits = 0
    for q in range(0, 120, 12):
        near = {r["id"] for r in S.ivf_search(index, c, x[q].tolist(), 5, 4).collect()}
        hits += len(near & set(np.argsort(np.linalg.norm(x - x[q], axis=1))[:5].tolist()))
    assert hits / 50 >= 0.9


def test_vec_join_is_exact(points):
    x, df = points
    got = {(r[0], r[1]) for r in S.vec_join(df, df, "v", "v", 0.6, pivots=5).collect()}
    d = np.linalg.norm(x[:, None] - x, axis=2)
    assert got == {(i, j) for i in range(120) for j in range(120) if d[i, j] <= 0.6}
    assert S.vec_join(df, df.limit(0), "v", "v", 0.6).count() == 0


def test_mmr(points):
    x, df = points
    q = [1.0, 0.5, 0.2, 0.1]
    got = [r["id"] for r in S.diverse(df, "v", q, 4, pool=30).orderBy("rank").collect()]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rel = unit @ (np.array(q) / np.linalg.norm(q))
    pool, chosen = np.lexsort((np.arange(120), -rel))[:30].tolist(), []
    while len(chosen) < 4:
        best = max(pool, key=lambda i: 0.5 * rel[i] - 0.5 * max([0.0, *(unit[i] @ unit[j] for j in chosen)]))
        chosen.append(best)
        pool.remove(best)
    assert got == chosen
    r = df.limit(1).select(S.mmr_rerank(F.array(*map(F.lit, q)), F.array(F.array(*map(F.lit, q)), F.array(*map(F.lit, q)), F.array(*[F.lit(-z) for z in q])), 0.5, 2).alias("m")).first()[0]
    assert r[0] == 1


def test_graph(spark):
    pairs = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (5, 6)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    assert {(r[0], r[1], r[2]) for r in G.bfs(e, 0).collect()} == {(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 1), (4, 3, 3)}
    assert {r[0] for r in G.bfs(e, 0, 1).collect()} == {0, 1, 2}
    assert {(r[0], r[1], r[2], r[3]) for r in G.dfs(e, 0).collect()} == {(0, 1, 10, None), (1, 2, 7, 0), (3, 3, 6, 1), (4, 4, 5, 3), (2, 8, 9, 0)}
    label = {r[0]: r[1] for r in G.communities(e, 10).collect()}
    assert label[5] == label[6] != label[0]
    assert abs(sum(r[1] for r in G.pagerank(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")).collect()) - 1) < 1e-6


def test_clusters(points):
    x, df = points
    for found in (L.predict(L.kmeans(df, "v", 3), df, "v", "c"), L.assign(df, "v", L.minibatch_kmeans(df, "v", 3, 40, 3), "c")):
        rows = found.select("label", "c").distinct().count()
        assert rows <= 5
    db = {r[0]: r[1] for r in L.dbscan(df, "v", 0.8, 4).collect()}
    d = np.linalg.norm(x[:, None] - x, axis=2) <= 0.8
    core = d.sum(1) >= 4
    assert {i for i, c in db.items() if c == -1} == {i for i in range(120) if not (d[i] & core).any()}
    for i in range(120):
        for j in range(120):
            if core[i] and core[j] and d[i, j]:
                assert db[i] == db[j]
    h = {r[0]: r[1] for r in L.hierarchical(df, "v", 3).collect()}
    assert len({h[i] for i in range(40)}) == 1 and len(set(h.values())) == 3
    with pytest.raises(ValueError):
        L.hierarchical(df, "v", 3, limit=10)


def test_pca_and_whitening(points):
    x, df = points
    z = np.array([r[0] for r in L.pca(df, "v", 2).orderBy("id").select("projected").collect()])
    _, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.linalg.norm(z, axis=0), s[:2])
    w = np.array([r[0] for r in L.whiten(df, "v", 1e-9).select("whitened").collect()])
    assert np.allclose(np.cov(w.T, bias=True), np.eye(4), atol=1e-4)
    rot = L.opq_rotation(df, "v", 2)
    assert np.allclose(rot @ rot.T, np.eye(4), atol=1e-8)
    books = L.pq_train(df, "v", 2, 16)
    got = L.pq_encode(df, "v", books).select(L.pq_distance("codes", x[0].tolist(), books)).collect()
    assert np.corrcoef([g[0] for g in got], np.linalg.norm(x - x[0], axis=1))[0, 1] > 0.98


def test_learners(spark, points):
    x, df = points
    y = df.withColumn("y", (F.col("label") == 2).cast("int"))
    for a in ("logistic_regression", "naive_bayes", "decision_tree"):
        assert L.evaluate(L.train(a, y, "v", "y"), y, "v", "y")["accuracy"] > 0.9
    assert min(m["accuracy"] for m in L.cross_validate("naive_bayes", y, "v", "y", 3)) > 0.8
    with pytest.raises(ValueError):
        L.train("nothing", y, "v", "y")
    w = np.array([1.0, -2.0, 0.5, 3.0])
    lin = spark.createDataFrame([(v.tolist(), float(v @ w + 7)) for v in x], "v array<double>, y double")
    m = L.linear_regression(lin, "v", "y")
    assert np.allclose(m.coefficients, w, atol=1e-4) and abs(m.intercept - 7) < 1e-4
    assert np.allclose(L.lasso_regression(lin, "v", "y", 1e-9).coefficients, w, atol=1e-3)
    assert L.from_json(L.to_json(m)) == m
    scores = {r[0]: r[1] for r in L.isolation_scores(df.unionByName(spark.createDataFrame([(999, [9.0] * 4, 0)], df.schema)), "v").collect()}
    assert max(scores, key=scores.get) == 999
    lof = {r[0]: r[1] for r in L.local_outlier_factor(df.unionByName(spark.createDataFrame([(999, [9.0] * 4, 0)], df.schema)), "v", 5).collect()}
    assert max(lof, key=lof.get) == 999


def test_stats(spark, points):
    _, df = points
    out = X.outliers(df.unionByName(spark.createDataFrame([(999, [30.0] * 4, 0)], df.schema)), "v")
    assert [r[0] for r in out.filter("is_outlier").collect()] == [999]
    with pytest.raises(ValueError):
        X.outliers(df, "v", "nothing")
    d = X.centroid_drift(df.filter("label = 0"), df.filter("label = 2"), "v")
    assert d["significant"] and X.divergence(df, df, "v") == pytest.approx(0)
    with pytest.raises(ValueError):
        X.centroid_drift(df.limit(3), df, "v")
    a = vector_aggregate(df, "v", "sum").first()
    assert a["n"] == 120 and np.allclose(a["vector"], points[0].sum(0))
    with pytest.raises(Exception, match="different lengths"):
        vector_aggregate(df.unionByName(spark.createDataFrame([(1, [1.0], 0)], df.schema)), "v").collect()


def test_series(spark):
    d = spark.createDataFrame([(i, float(3 * i + 5)) for i in range(50)], "t int, y double")
    assert np.allclose(TS.fit_ar(d, "t", "y", 1, 1).forecast(3), [155, 158, 161], atol=1e-3)
    s = spark.createDataFrame([(i, float(i + (10 if i % 4 == 0 else 0))) for i in range(40)], "t int, y double")
    assert max(abs(r["residual"]) for r in TS.seasonal_decompose(s, "t", "y", 4).dropna().collect()) < 1e-9


def test_rerank(spark):
    d = spark.createDataFrame([(1, "a mit license"), (2, "nothing"), (3, None)], "id int, t string")
    assert [r["id"] for r in R.rerank(d, "mit license", "t", top_k=2).orderBy("rank").collect()] == [1, 2]
    lists = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (2, 20, 1), (2, 10, 2), (2, 30, 3), (1, -1, 3)], "list int, id int, rank int")
    assert {r[0]: r[1] for r in R.borda(lists).collect()} == {10: 4, 20: 4, 30: 1}


def test_advice_and_tenancy(spark):
    assert A.tune_hnsw(5_000) == {"m": 12, "ef_construction": 200, "ef_search": 32} and A.tune_hnsw(10**7)["m"] == 32
    assert A.tune_ivf(10_000) == {"lists": 100, "probes": 10}
    assert A.recommend_index(20_000_000) == "ivf" and A.recommend_index(1000, 500) == "ivf" and A.recommend_index(1000) == "hnsw"
    assert A.tune_query(100, 0.5, 10) == 120 and A.tune_query(100, 0.99, 500) == 80 and A.tune_query(16, 0.99, 500) == 16
    assert A.auto_route("find vector") == "ann" and A.scale_precision(0.9, 0.99) == "int8"
    assert A.select_replica([("b", 10, 0.9), ("a", 10, 0.9), ("c", 50, 0.9)]) == "a"
    u = spark.createDataFrame([(1, 50, 10, 1), (2, 500, 10, 1)], "tenant_id int, vectors long, storage_bytes long, qps long")
    q = spark.createDataFrame([(1, 100, 100, 10)], "tenant_id int, max_vectors long, max_storage long, max_qps long")
    assert A.check_quota(u, q, 1, 50) and not A.check_quota(u, q, 1, 51) and A.check_quota(u, q, 2, 10**9)
    h = A.latency_histogram(spark.createDataFrame([(float(i),) for i in range(100)], "l double"), "l", [10.0, 50.0])
    assert A.histogram_percentile(h, 0.5) == 50.0 and A.histogram_percentile(h, 0.99) == float("inf")


def test_catalog(spark, points, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/models")
    y = points[1].withColumn("y", (F.col("label") == 2).cast("int"))
    c.create_project("p")
    with pytest.raises(ValueError):
        c.create_project("p")
    assert c.save("p", L.naive_bayes(y, "v", "y"), "naive_bayes", metrics={"accuracy": 1.0}) == 1
    assert c.save("p", L.train("decision_tree", y, "v", "y"), "decision_tree") == 2
    assert c.deployed("p") is None and c.deploy("p", 1) == 1 and c.project("p")["deployed"] == 1
    assert isinstance(c.load("p"), L.GaussianNB) and L.evaluate(c.load("p", 2), y, "v", "y")["accuracy"] > 0.9
    assert c.models().count() == 2 and c.drop("p", 2) and c.versions("p") == [1] and c.delete_project("p") and c.projects() == []


def test_sources(spark, points, tmp_path):
    df = points[1].select("id", "v").limit(5)
    for kind in ("parquet", "json", "csv"):
        io.save(df, f"{tmp_path}/{kind}", "jsonl" if kind == "json" else kind)
        back = io.load(spark, "jsonl" if kind == "json" else kind, f"{tmp_path}/{kind}", vector="v")
        assert sorted((r["id"], [round(x, 6) for x in r["v"]]) for r in back.collect()) == sorted((r["id"], [round(x, 6) for x in r["v"]]) for r in df.collect())
    with pytest.raises(ValueError):
        io.load(spark, "xml", "nowhere")


def test_streams(spark, tmp_path):
    from vectrill.streaming.windows import read_events, running_drift, tumbling

    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 2, float(i)) for i in range(60)]
    b = spark.createDataFrame(rows, "id int, s string, k int, v double").select("id", F.to_timestamp("s").alias("ts"), "k", "v")
    b.repartition(3).write.parquet(f"{tmp_path}/in")
    out = {}
    for name, mode, f in (("w", "complete", lambda e: tumbling(e, "ts", "v", "10 minutes")), ("d", "update", lambda e: running_drift(e, "k", "v"))):
        q = f(read_events(spark, f"{tmp_path}/in", b.schema, 1)).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        out[name] = spark.table(name).collect()
    assert sorted((str(r[0]), r["n"], r["total"]) for r in out["w"]) == sorted((str(r[0]), r["n"], r["total"]) for r in tumbling(b, "ts", "v", "10 minutes").collect())
    assert max(r["n"] for r in out["d"] if r["k"] == 0) == 30


def test_vec_join_in_blocks(spark, monkeypatch):
    """Several cells and blocks, vectors of two lengths, nulls, ids repeated, pairs at distance zero."""
    monkeypatch.setattr(S, "JOIN_BLOCK", 7)
    rng = np.random.default_rng(12)
    a = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(100, [1.0, 2.0]), (101, None), (102, [1.0, 2.5])]
    b = [(i, rng.normal(size=3).tolist()) for i in range(80)] + [(7, a[0][1]), (200, [1.0, 2.0]), (201, None), (202, [])]
    one, two = (spark.createDataFrame(x, "id long, v array<double>") for x in (a, b))
    for pivots in (None, 4):
        got = sorted((r[0], r[1], round(r[2], 9)) for r in S.vec_join(one, two, "v", "v", 0.7, pivots=pivots).collect())
        want = sorted((i, j, round(float(np.linalg.norm(np.subtract(x, y))), 9)) for i, x in a for j, y in b if x and y and len(x) == len(y) and np.linalg.norm(np.subtract(x, y)) <= 0.7)
        assert got == want and any(d == 0 for *_, d in got)


def test_knn_batch_ties_and_blocks(spark):
    rows = [(i, [float(i % 4), 0.0]) for i in range(40)] + [(50, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = {(q, r + 1): i for q in (0, 1, 2, 3, 4, 5) for r, i in enumerate(sorted((i for i in range(40)), key=lambda i: (abs(i % 4 - q % 4), i))[:6])}
    for block in (10_000, 2):
        got = S.knn_batch(df, "v", df.filter("id < 6"), "v", 6, block=block).collect()
        assert {(r["query_id"], r["rank"]): r["id"] for r in got} == want
    assert S.knn_batch(df, "v", df.filter("id = 0"), "v", 100).count() == 40


def test_multi_vector_ways(spark):
    from vectrill.operators.search import combined

    df = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    assert df.select(*[combined([F.col("a"), F.col("b")], h) for h in ("max", "min", "avg")]).first()[:] == (3.0, 1.0, 2.0)


def test_depth_first_search_walks_any_numbers_of_nodes_and_edges(spark, monkeypatch):
    """No limit of edges unless given; sorted runs shorter than a node's neighbours, against a plain loop."""
    monkeypatch.setattr(G, "RUN", 16)
    rng = np.random.default_rng(5)
    for scale in (1, -(10**12)):
        pairs = [(int(a) * scale, int(b) * scale) for a, b in rng.integers(0, 60, (900, 2))] + [(0, i * scale) for i in range(90)]
        near = {}
        for a, b in sorted(set(pairs)):
            near.setdefault(a, []).append(b)
        clock, rows, seen = 1, {0: [1, 0, None]}, {0}
        stack = [(0, iter(near[0]))]
        while stack:
            nxt = next((d for d in stack[-1][1] if d not in seen), None)
            clock += 1
            if nxt is None:
                rows[stack.pop()[0]][1] = clock
            else:
                seen.add(nxt)
                rows[nxt] = [clock, 0, stack[-1][0]]
                stack.append((nxt, iter(near.get(nxt, []))))
        assert {tuple(r) for r in G.dfs(spark.createDataFrame(pairs, "src long, dst long"), 0).collect()} == {(n, *v) for n, v in rows.items()}
    star = spark.range(3000).select(F.lit(0).alias("src"), F.col("id").alias("dst"))
    assert G.dfs(star, 0).agg(F.max("finish")).first()[0] == 6000 and inspect.signature(G.dfs).parameters["max_edges"].default is None
    with pytest.raises(ValueError):
        G.dfs(star, 0, max_edges=10)


@pytest.mark.parametrize("linkage", ["average", "single", "complete"])
def test_agglomeration_in_rounds_is_that_of_the_matrix(spark, monkeypatch, linkage):
    """More rows than one matrix takes; tiles smaller than clusters."""
    rng = np.random.default_rng(9)
    rows = [(i * 3, x.tolist()) for i, x in enumerate(np.concatenate([rng.normal(c, 1, (60, 3)) for c in (-2, 0, 3)]))] + [(1, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = {k: {tuple(r) for r in L.hierarchical(df, "v", k, linkage).collect()} for k in (1, 5, 40)}
    for name, value in (("FINISH", 12), ("TALL", 8), ("WIDE", 16)):
        monkeypatch.setattr(L.agglomerate, name, value)
    for k in want:
        assert {tuple(r) for r in L.hierarchical(df, "v", k, linkage).collect()} == want[k]
    assert inspect.signature(L.hierarchical).parameters["limit"].default is None


def test_batch_searches_compare_by_matrix_products(spark, points, monkeypatch):
    """More queries than a block meet the rows in tiles, once; cells are compared with those that probe them."""
    x, df = points
    calls = []
    monkeypatch.setattr(S, "cut", lambda d: calls.append(1) or d)
    got = {(r["query_id"], r["rank"]): r["id"] for r in S.knn_batch(df, "v", df, "v", 4, block=6).collect()}
    assert len(calls) <= 2, "a checkpoint for each block of queries"
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert got == {(q, r + 1): int(i) for q in range(120) for r, i in enumerate(np.lexsort((np.arange(120), d[q]))[:4])}
    c, index = S.ivf_build(df, "v", 6)
    cells = {r["id"]: r["cell"] for r in index.collect()}
    near = ((x[:, None] - c[None]) ** 2).sum(2).argsort(1, kind="stable")[:, :2]
    for block in (1000, 50):
        found = S.ivf_search_batch(index, c, df, "v", 3, 2, block=block)
        assert "Join" not in found._jdf.queryExecution().toString()
        want = {}
        for q in range(120):
            i = np.array([i for i in range(120) if cells[i] in near[q]])
            want |= {(q, r + 1): int(i[o]) for r, o in enumerate(np.lexsort((i, np.round(d[q, i], 7)))[:3])}
        assert {(r["query_id"], r["rank"]): r["id"] for r in found.collect()} == want


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
@pytest.mark.parametrize("scale, shift", [(1, 0), (1, 100), (1e-20, 0), (1e20, 0)])
def test_nearest_is_exact_whatever_the_scale(metric, scale, shift):
    from vectrill.operators.tiles import Nearest

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(2000, 6)), rng.integers(0, 2, (400, 6))]) * scale + shift
    q, ids = x[::60], rng.permutation(len(x))
    best = Nearest(q, 7, metric)
    for s in range(0, len(x), 700):
        best.add(x[s : s + 700], ids[s : s + 700])
    if metric == "l2":
        d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    else:
        d = -(q[:, None] * x[None]).sum(2)
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1) if metric == "cosine" else 1
        d = np.where(n == 0, 1, 1 + d / np.where(n == 0, 1, n)) if metric == "cosine" else d
    assert np.allclose(best.d, np.sort(d, axis=1)[:, :7], rtol=1e-9, atol=1e-12 if metric == "cosine" else 0)


def test_vector_pairs_are_neither_copied_nor_kept_by_the_pair(spark, monkeypatch):
    """A join copies a row once a tile of the other side; clusters keep rows, not the pairs within eps."""
    monkeypatch.setattr(S, "JOIN_BLOCK", 8)
    x = np.random.default_rng(6).normal(size=(400, 8))
    x[:20] *= 6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    copies, kept = [], []
    meet, whole = S.tiles.meet, L.cut
    monkeypatch.setattr(S.tiles, "meet", lambda a, b, *rest: copies.append(a.count() + b.count()) or meet(a, b, *rest))
    monkeypatch.setattr(L, "cut", lambda d: kept.append((out := whole(d)).count()) or out)
    d = np.linalg.norm(x[:, None] - x, axis=2) <= 3.6
    assert S.vec_join(df, df, "v", "v", 3.6).count() == d.sum() > 50_000
    assert copies[0] <= 2 * 400 * (S.tiles.GROUPS + 3)
    got = {r[0]: r[1] for r in L.dbscan(df, "v", 3.6, 100).collect()}
    assert max(kept) < 12_000
    core = d.sum(1) >= 100
    label = np.where(core, np.arange(400), 10**6)
    for _ in range(400):
        label = np.where(core, np.where(d & core, label[None], 10**6).min(1), label)
    border = np.where(d & core, label[None], 10**6).min(1)
    names = {v: n for n, v in enumerate(sorted(set(label[core].tolist())))}
    assert got == {i: names.get(int(border[i]), -1) for i in range(400)} and -1 in got.values()


def test_graph_rounds_read_the_edges_once(spark):
    """Edges are an expensive join elsewhere; repeated edges count in the ranks, not in the communities."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    pairs = [(i, (i * 7 + k) % 40) for i in range(40) for k in (1, 3)] + [(0, 1)] * 3 + [(41, 5)]
    e = spark.createDataFrame(pairs, "src long, dst long").mapInArrow(counted, "src long, dst long")
    got = {}
    for name, run in (("bfs", lambda: G.bfs(e, 0)), ("rank", lambda: G.pagerank(e, iterations=4, tolerance=0)), ("label", lambda: G.communities(e, 4))):
        read.value = 0
        got[name] = {r[0]: r[1] for r in run().collect()}
        assert read.value == len(pairs), name
    nodes = sorted({n for p in pairs for n in p})
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(4):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / sum(p[0] == a for p in pairs)
        rank = new
    assert all(abs(got["rank"][n] - rank[n]) < 1e-12 for n in nodes)
    near = {n: {n} | {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in nodes}
    label = {n: n for n in nodes}
    for _ in range(4):
        votes = {n: [label[m] for m in near[n]] for n in nodes}
        label = {n: min(v, key=lambda c: (-v.count(c), c)) for n, v in votes.items()}
    assert got["label"] == label
