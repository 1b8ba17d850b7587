"""Queries take part in their whole tables, where a table is larger than the one it is joined to."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vectrill.plans import all_queries
from vectrill.plans.searching import doc_vectors


def test_every_document_has_a_vector(spark, tmp_path):
    v = lambda i: [float(i == k) for k in range(64)]
    spark.createDataFrame([(i, v(i), i) for i in range(6)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "the and license", "en", "web") for i in range(8)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["id"] for r in doc_vectors(spark, str(tmp_path)).collect()}
    assert got == {i: i % 6 for i in range(8)}
    for name in ("hybrid_search", "semantic_keyword"):
        assert {r["id"] for r in all_queries()[name](spark, str(tmp_path)).collect()} == set(range(8))
    assert all_queries()["topics"](spark, str(tmp_path)).agg(F.sum("n")).first()[0] == 8


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ivf_search_finds_nine_of_ten(spark, sf):
    d = f"/root/testdata/{sf}"
    if not Path(d).exists():
        pytest.skip("no test tables")
    got = {(r["query_id"], r["id"]) for r in all_queries()["ivf_search"](spark, d).collect()}
    from vectrill.operators.search import knn_batch

    e = spark.read.parquet(f"{d}/embeddings.parquet")
    want = {(r["query_id"], r["id"]) for r in knn_batch(e, "embedding", e.filter("vec_id % 100 = 0"), "embedding", 10, id_col="vec_id", query_id="vec_id").collect()}
    assert {q for q, _ in got} == {q for q, _ in want}
    others = {(q, i) for q, i in want if q != i}
    assert len(got & others) >= 0.9 * len(others)


SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@tables
def test_graphs_read_the_orders(spark):
    o = {r["o_orderkey"]: r["o_custkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    next_to = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        c, p = 2 * o[r["l_orderkey"]], 2 * r["l_partkey"] + 1
        next_to.setdefault(c, set()).add(p)
        next_to.setdefault(p, set()).add(c)
    depth, layer = {0: 0}, [0]
    while layer:
        layer = sorted({d for s in layer for d in next_to[s]} - set(depth))
        depth |= {d: depth[min(next_to[d] & set(depth), key=depth.get)] + 1 for d in layer}
    run = {n: all_queries()[n](spark, SF).collect() for n in ("graph_bfs_orders", "graph_pagerank_orders", "graph_communities", "graph_dfs")}
    assert {r["node"]: r["depth"] for r in run["graph_bfs_orders"]} == depth
    assert {r["node"] for r in run["graph_dfs"]} == set(depth)
    assert {r["node"] for r in run["graph_communities"]} == set(next_to) == {r["node"] for r in run["graph_pagerank_orders"]}
    assert abs(sum(r["score"] for r in run["graph_pagerank_orders"]) - 1) < 1e-4


@tables
def test_vector_graphs_reach_all_vectors(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    mean = all_queries()["neighbour_mean_vectors"](spark, SF).collect()
    assert len(mean) == n and {r["n"] for r in mean} == {4}
    assert max(r["node"] for r in all_queries()["graph_knn_vectors"](spark, SF).collect()) > 24
