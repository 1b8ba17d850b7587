"""Search, fusion, reranking, ranking metrics and text queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.functions import irmetrics as M
from vectrill.functions import text as T
from vectrill.functions import vector as V
from vectrill.operators import admin as A
from vectrill.operators import rerank as R
from vectrill.operators import search as S
from vectrill.plans.registry import query, read
from vectrill.plans.vectors import OTHER, OTHER_SQL, PROBE, PROBE_SQL, emb, r6

NOW = "2024-02-01 00:00:00"
WORDS = "the and license"
_E = "embedding::DOUBLE[]"
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


def doc_vectors(spark, sf_dir):
    """Every document with the vector of its number modulo the number of vectors."""
    e = emb(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding", "label")
    d = docs(spark, sf_dir).crossJoin(F.broadcast(e.agg(F.count("*").alias("_n"))))  # one row
    return d.join(e, F.expr("pmod(doc_id, nullif(_n, 0))") == F.col("id")).drop("_n")


_DV = f"(SELECT doc_id AS id, text, lang, source, label, {_E} AS e, {_TOK} AS w FROM documents CROSS JOIN (SELECT count(*) AS n FROM embeddings) JOIN embeddings ON doc_id % n = vec_id)"
_RANK = "(len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'and')) + len(list_filter(w, lambda x: x = 'license'))) / (len(w) + 1)"


@query("knn_cosine_filtered", f"SELECT vec_id AS id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, 1 - list_cosine_similarity({_E}, {PROBE_SQL}) AS d FROM embeddings WHERE label IN (1, 3, 5)) ORDER BY d, vec_id LIMIT 20")
def knn_cosine_filtered(spark, sf_dir):
    return S.knn(emb(spark, sf_dir), "embedding", PROBE, 20, metric="cosine", id_col="vec_id", where=F.col("label").isin(1, 3, 5)).select("id", r6(F.col("distance")).alias("distance"))


@query("knn_inner_product", f"SELECT vec_id AS id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, -list_inner_product({_E}, {PROBE_SQL}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 15")
def knn_inner_product(spark, sf_dir):
    return S.knn(emb(spark, sf_dir), "embedding", PROBE, 15, metric="inner_product", id_col="vec_id").select("id", r6(F.col("distance")).alias("distance"))


@query("knn_batch", f"WITH q AS (SELECT vec_id AS q, {_E} AS v FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q, vec_id AS id, list_distance(v, {_E}) AS d FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 7), id) AS rank FROM p) SELECT q AS query_id, id, round(d, 5) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_batch(spark, sf_dir):
    """A stated query set: every hundredth vector against all."""
    e = emb(spark, sf_dir)
    return S.knn_batch(e, "embedding", e.filter("vec_id % 100 = 0"), "embedding", 5, id_col="vec_id", query_id="vec_id").withColumn("distance", F.round("distance", 5) + F.lit(0.0))


@query("vec_join_threshold", f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_distance(a.{_E}, b.{_E}), 6) + 0.0 AS distance FROM embeddings a JOIN embeddings b ON list_distance(a.{_E}, b.{_E}) <= 1.2")
def vec_join_threshold(spark, sf_dir):
    e = emb(spark, sf_dir)
    return S.vec_join(e, e, "embedding", "embedding", 1.2, left_id="vec_id", right_id="vec_id").withColumn("distance", r6(F.col("distance")))


@query("faceted_search", f"SELECT facet, id, round(score, 6) + 0.0 AS score FROM (SELECT label AS facet, vec_id AS id, 1 - list_distance({_E}, {PROBE_SQL}) AS score, row_number() OVER (PARTITION BY label ORDER BY 1 - list_distance({_E}, {PROBE_SQL}) DESC, vec_id) AS rn FROM embeddings) WHERE rn <= 3")
def faceted_search(spark, sf_dir):
    return S.faceted(emb(spark, sf_dir), "embedding", PROBE, "label", 3, id_col="vec_id").withColumn("score", r6(F.col("score")))


_EV = f"(SELECT event_id AS id, {_E} AS e, ts, user_id, date_diff('second', ts, TIMESTAMP '{NOW}') / 86400.0::DOUBLE AS age FROM (SELECT event_id, date_trunc('second', ts) AS ts, user_id FROM events) CROSS JOIN (SELECT count(*) AS n FROM embeddings) JOIN embeddings ON event_id % n = vec_id)"


def event_vectors(spark, sf_dir):
    """Every event with the vector of its number modulo the number of vectors."""
    e = emb(spark, sf_dir).select("vec_id", "embedding")
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id").crossJoin(F.broadcast(e.agg(F.count("*").alias("_n"))))  # one row
    return ev.join(e, F.expr("pmod(event_id, nullif(_n, 0))") == F.col("vec_id")).drop("_n")


@query("temporal_search", f"SELECT id, round(score, 6) + 0.0 AS score FROM (SELECT id, (1 - list_distance(e, {PROBE_SQL})) * exp(-0.01 * age) AS score FROM {_EV}) ORDER BY score DESC, id LIMIT 10")
def temporal_search(spark, sf_dir):
    return S.temporal_search(event_vectors(spark, sf_dir), "embedding", PROBE, "ts", NOW, 10, id_col="event_id").select("id", r6(F.col("score")).alias("score"))


@query("temporal_score", f"SELECT id, round(0.5 / (1 + list_distance(e, {PROBE_SQL})) + 0.5 * exp(-0.1 * age), 6) + 0.0 AS score, round(exp(-0.1 * age), 6) + 0.0 AS decay, age <= 14 AS recent FROM {_EV}")
def temporal_score(spark, sf_dir):
    d = event_vectors(spark, sf_dir)
    return d.select(F.col("event_id").alias("id"), r6(S.temporal_score(V.l2_distance("embedding", PROBE), "ts", NOW)).alias("score"), r6(S.temporal_decay("ts", NOW, 0.1)).alias("decay"), S.temporal_filter("ts", NOW, 14).alias("recent"))


@query("tenant_search", f"SELECT id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id AS id, list_distance({_E}, {PROBE_SQL}) AS d FROM embeddings WHERE label = 3) ORDER BY d, id LIMIT 10")
def tenant_search(spark, sf_dir):
    """The label stands for the tenant."""
    return S.knn(A.for_tenant(emb(spark, sf_dir), "label", 3), "embedding", PROBE, 10, id_col="vec_id").select("id", r6(F.col("distance")).alias("distance"))


@query("hybrid_search", f"SELECT id, round(score, 6) + 0.0 AS score FROM (SELECT id, 0.7 * (1 - list_distance(e, {PROBE_SQL})) + 0.3 * {_RANK} AS score FROM {_DV}) ORDER BY score DESC, id LIMIT 10")
def hybrid_search(spark, sf_dir):
    return S.hybrid(doc_vectors(spark, sf_dir), "embedding", "text", PROBE, WORDS, 10, id_col="doc_id").select("id", r6(F.col("score")).alias("score"))


@query("semantic_keyword", f"SELECT id, round(score, 6) + 0.0 AS score FROM (SELECT id, 1 - list_distance(e, {PROBE_SQL}) + (len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'and'))) / (len(w) + 1) AS score FROM {_DV} WHERE list_contains(w, 'the') AND list_contains(w, 'and')) ORDER BY score DESC, id LIMIT 10")
def semantic_keyword(spark, sf_dir):
    return S.semantic_keyword(doc_vectors(spark, sf_dir), "embedding", "text", PROBE, "the and", 10, id_col="doc_id").select("id", r6(F.col("score")).alias("score"))


@query("multi_vector_search", f"SELECT id, how, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY how ORDER BY score DESC, id) AS rn FROM (SELECT vec_id AS id, unnest(['max', 'min', 'avg']) AS how, unnest([greatest(a, b), least(a, b), (a + b) / 2]) AS score FROM (SELECT vec_id, 1 - list_distance({_E}, {PROBE_SQL}) AS a, 1 - list_distance({_E}, {OTHER_SQL}) AS b FROM embeddings))) WHERE rn <= 10")
def multi_vector_search(spark, sf_dir):
    """The three ways share one scan: both scores are computed once and each way ranks them."""
    d = emb(spark, sf_dir).select("vec_id", *[(1 - V.l2_distance("embedding", q)).alias(c) for q, c in ((PROBE, "a"), (OTHER, "b"))])
    ways = F.array(*[F.struct(F.lit(how).alias("how"), S.combined([F.col("a"), F.col("b")], how).alias("score")) for how in ("max", "min", "avg")])
    rank = F.row_number().over(W.partitionBy("how").orderBy(F.desc("score"), "id"))
    rows = d.select(F.col("vec_id").alias("id"), F.inline(ways)).filter("score IS NOT NULL")
    return rows.withColumn("rank", rank).filter("rank <= 10").select("id", "how", r6(F.col("score")).alias("score"))


@query("metadata_search", "SELECT k, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM (SELECT CAST(props::JSON->>'k' AS VARCHAR) AS k, value FROM events) WHERE k IN ('1', '2') GROUP BY k")
def metadata_search(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    both = e.filter(S.metadata_contains("props", {"k": "1"}) | S.metadata_contains("props", {"k": "2"}))
    return both.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), (F.round(F.sum("value"), 4) + F.lit(0.0)).alias("total"))


@query("diverse_search")
def diverse_search(spark, sf_dir):
    """Greedy selection; SQL has no equal. Tested against brute force."""
    return S.diverse(emb(spark, sf_dir), "embedding", PROBE, 10, id_col="vec_id").withColumn("score", r6(F.col("score")))


_R1 = f"(SELECT vec_id AS id, row_number() OVER (ORDER BY list_distance({_E}, {PROBE_SQL}), vec_id) AS rank FROM embeddings QUALIFY rank <= 50)"
_R2 = f"(SELECT vec_id AS id, row_number() OVER (ORDER BY list_distance({_E}, {OTHER_SQL}), vec_id) AS rank FROM embeddings QUALIFY rank <= 50)"


def ranked(spark, sf_dir, q, k=50):
    top = S.knn(emb(spark, sf_dir), "embedding", q, k, id_col="vec_id")
    return top.withColumn("rank", F.row_number().over(W.orderBy("distance", "id")))


@query("rrf_fusion", f"SELECT id, round(sum(1.0 / (60 + rank)), 8) + 0.0 AS score FROM (SELECT * FROM {_R1} UNION ALL SELECT * FROM {_R2}) GROUP BY id")
def rrf_fusion(spark, sf_dir):
    return S.rrf([ranked(spark, sf_dir, PROBE), ranked(spark, sf_dir, OTHER)]).select("id", (F.round("score", 8) + F.lit(0.0)).alias("score"))


_TWO = f"(SELECT vec_id AS id, -list_distance({_E}, {PROBE_SQL}) AS s, list_inner_product({_E}, {OTHER_SQL}) AS l FROM embeddings)"


@query("weighted_fusion", f"SELECT id, round(0.6 * (s - slo) / (shi - slo) + 0.4 * (l - llo) / (lhi - llo), 6) + 0.0 AS score FROM {_TWO}, (SELECT min(s) AS slo, max(s) AS shi, min(l) AS llo, max(l) AS lhi FROM {_TWO})")
def weighted_fusion(spark, sf_dir):
    d = emb(spark, sf_dir).select("vec_id", (-V.l2_distance("embedding", PROBE)).alias("s"), V.inner_product("embedding", OTHER).alias("l"))
    return S.fusion(d, "s", "l", 0.6, id_col="vec_id").select("id", r6(F.col("score")).alias("score"))


@query("hybrid_rank", f"SELECT id, round(0.5 * s + 0.3 * l + 0.2 * 0.25, 6) + 0.0 AS score, round(1.0 / (60 + id) + 1.0 / (60 + 2 * id + 1), 8) + 0.0 AS rrf FROM {_TWO}")
def hybrid_rank(spark, sf_dir):
    d = emb(spark, sf_dir).select(F.col("vec_id").alias("id"), (-V.l2_distance("embedding", PROBE)).alias("s"), V.inner_product("embedding", OTHER).alias("l"))
    return d.select("id", r6(S.hybrid_rank(F.col("s"), F.col("l"), 0.25)).alias("score"), (F.round(S.rrf_score(F.col("id"), 2 * F.col("id") + 1), 8) + F.lit(0.0)).alias("rrf"))


SPARSE = {1: 1.0, 5: 0.5, 12: 2.0}
_SPQ = "greatest(e[2], 0.0) * 1.0 + greatest(e[6], 0.0) * 0.5 + greatest(e[13], 0.0) * 2.0"


def positive_sparse(spark, sf_dir):
    pos = F.transform(V.vec("embedding"), lambda x: F.greatest(x, F.lit(0.0)))
    return emb(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding", V.to_sparse(pos).alias("s"))


@query("sparse_search", f"SELECT id, round(score, 6) + 0.0 AS score FROM (SELECT vec_id AS id, {_SPQ} AS score FROM (SELECT vec_id, {_E} AS e FROM embeddings)) WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def sparse_search(spark, sf_dir):
    return S.sparse_search(positive_sparse(spark, sf_dir), "s", SPARSE, 10).select("id", r6(F.col("score")).alias("score"))


@query(
    "dense_sparse_search",
    f"""WITH x AS (SELECT vec_id AS id, list_distance({_E}, {PROBE_SQL}) AS d, {_SPQ.replace("e[", "embedding[")} AS s FROM embeddings), a AS (SELECT id, 1 / (1 + d) AS ds FROM x ORDER BY d, id LIMIT 20), b AS (SELECT id, s AS ss FROM x WHERE s > 0 ORDER BY s DESC, id LIMIT 20)
    SELECT id, round(score, 5) + 0.0 AS score FROM (SELECT coalesce(a.id, b.id) AS id, 0.5 * coalesce(ds, 0) + 0.5 * coalesce(ss, 0) AS score FROM a FULL JOIN b ON a.id = b.id) ORDER BY score DESC, id LIMIT 10""",
)
def dense_sparse_search(spark, sf_dir):
    p = positive_sparse(spark, sf_dir)
    out = S.dense_sparse(S.knn(p, "embedding", PROBE, 20), S.sparse_search(p, "s", SPARSE, 20), 10)
    return out.select("id", (F.round("score", 5) + F.lit(0.0)).alias("score"))


@query("distributed_search", f"SELECT id, round(d, 6) + 0.0 AS distance, CAST('node' || (id % 3) AS VARCHAR) AS node FROM (SELECT vec_id AS id, list_distance({_E}, {PROBE_SQL}) AS d FROM embeddings) ORDER BY d, id LIMIT 10")
def distributed_search(spark, sf_dir):
    """Three shards searched each, then merged."""
    e = emb(spark, sf_dir)
    parts = [S.knn(e, "embedding", PROBE, 10, id_col="vec_id", where=F.col("vec_id") % 3 == n).withColumn("node", F.lit(f"node{n}")) for n in range(3)]
    return S.merge_results(parts, 10).select("id", r6(F.col("distance")).alias("distance"), "node")


@query("ivf_search")
def ivf_search(spark, sf_dir):
    """Every hundredth vector against the index; as many cells as a recall of 0.9 over these needs."""
    e = emb(spark, sf_dir)
    q = e.filter("vec_id % 100 = 0")
    c, index = S.ivf_build(e, "embedding", 16, id_col="vec_id")
    probes, _ = S.ivf_probes(index, c, q, "embedding", 10, 0.9, query_id="vec_id")
    return S.ivf_search_batch(index, c, q, "embedding", 10, probes, query_id="vec_id").withColumn("distance", r6(F.col("distance")))


@query("ltr_rerank", f"SELECT id, round(0.25 + 1.5 * s - 0.75 * l, 6) + 0.0 AS score FROM {_TWO}")
def ltr_rerank(spark, sf_dir):
    d = emb(spark, sf_dir).select("vec_id", (-V.l2_distance("embedding", PROBE)).alias("s"), V.inner_product("embedding", OTHER).alias("l"))
    return R.ltr(d, ["s", "l"], [1.5, -0.75], 0.25, id_col="vec_id").select("id", r6(F.col("score")).alias("score"))


@query("ensemble_weighted", f"SELECT id, round(0.75 * (s - slo) / (shi - slo) + 0.25 * (l - llo) / (lhi - llo), 6) + 0.0 AS score FROM {_TWO}, (SELECT min(s) AS slo, max(s) AS shi, min(l) AS llo, max(l) AS lhi FROM {_TWO})")
def ensemble_weighted(spark, sf_dir):
    d = emb(spark, sf_dir).select("vec_id", (-V.l2_distance("embedding", PROBE)).alias("s"), V.inner_product("embedding", OTHER).alias("l"))
    return R.weighted_ensemble(d, ["s", "l"], [3.0, 1.0], id_col="vec_id").select("id", r6(F.col("score")).alias("score"))


@query("ensemble_borda", f"SELECT id, CAST(sum(50 - rank + 1) AS BIGINT) AS points FROM (SELECT * FROM {_R1} UNION ALL SELECT * FROM {_R2}) WHERE id > 0 GROUP BY id")
def ensemble_borda(spark, sf_dir):
    lists = ranked(spark, sf_dir, PROBE).withColumn("list", F.lit(1)).unionByName(ranked(spark, sf_dir, OTHER).withColumn("list", F.lit(2)))
    return R.borda(lists).select("id", F.col("points").cast("long").alias("points"))


@query("colbert_maxsim", f"SELECT vec_id, round(greatest(a, b) + greatest(c, d), 6) + 0.0 AS score FROM (SELECT vec_id, list_inner_product({PROBE_SQL}[1:32], e[1:32]) AS a, list_inner_product({PROBE_SQL}[1:32], e[33:64]) AS b, list_inner_product({PROBE_SQL}[33:64], e[1:32]) AS c, list_inner_product({PROBE_SQL}[33:64], e[33:64]) AS d FROM (SELECT vec_id, {_E} AS e FROM embeddings))")
def colbert_maxsim(spark, sf_dir):
    halves = lambda v: F.array(V.slice_of(v, 0, 32), V.slice_of(v, 32, 64))
    d = emb(spark, sf_dir).select("vec_id", halves("embedding").alias("t"), halves(PROBE).alias("q"))
    return d.select("vec_id", r6(R.colbert(F.col("q"), F.col("t"))).alias("score"))


_EDIT = "CASE WHEN greatest(length(t), length(q)) = 0 THEN 1 ELSE 1 - levenshtein(t, q) / greatest(length(t), length(q)) END"


@query("rerank_edit", f"SELECT p_partkey AS id, round({_EDIT}, 6) + 0.0 AS score FROM (SELECT p_partkey, coalesce(p_name, '') AS t, 'part 17' AS q FROM part) ORDER BY {_EDIT} DESC, p_partkey LIMIT 10")
def rerank_edit(spark, sf_dir):
    """Over ASCII names: DuckDB counts edits of bytes, Spark of characters."""
    return R.rank_by_edit(read(spark, sf_dir, "part"), "part 17", "p_name", 10, id_col="p_partkey").select("id", r6(F.col("score")).alias("score"))


@query("rerank_scorer", "SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM (SELECT doc_id AS id, (list_contains(w, 'the')::INT + list_contains(w, 'mit')::INT + list_contains(w, 'license')::INT) / 3.0::DOUBLE AS score FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)) ORDER BY score DESC, id LIMIT 10")
def rerank_scorer(spark, sf_dir):
    """With the built-in scorer; a model's scorer takes its place as an argument."""
    return R.rerank(docs(spark, sf_dir), "the MIT license", "text", id_col="doc_id")


_IR = f"(SELECT q, list(id ORDER BY rank) AS got FROM (SELECT q.vec_id AS q, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.{_E}, e.{_E}), e.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings e) WHERE rank <= 10 GROUP BY q)"
_REL = "(SELECT label AS l, list(vec_id ORDER BY vec_id) AS rel FROM embeddings GROUP BY label)"


@query(
    "ir_metrics",
    f"""WITH x AS (SELECT q, got, rel, len(list_intersect(got[1:5], rel)) AS h FROM {_IR} JOIN embeddings e ON e.vec_id = q JOIN {_REL} ON l = e.label)
    SELECT q, round(h / len(rel), 6) + 0.0 AS recall, round(h / 5, 6) + 0.0 AS precision, round(CASE WHEN h = 0 THEN 0 ELSE 2 * (h / 5) * (h / len(rel)) / (h / 5 + h / len(rel)) END, 6) + 0.0 AS f1,
    round(coalesce(1 / list_min(list_filter(list_transform(got, lambda v, i: CASE WHEN list_contains(rel, v) THEN i END), lambda i: i IS NOT NULL)), 0), 6) + 0.0 AS reciprocal_rank FROM x""",
)
def ir_metrics(spark, sf_dir):
    e = emb(spark, sf_dir)
    got = S.knn_batch(e, "embedding", e.filter("vec_id % 100 = 0"), "embedding", 10, id_col="vec_id", query_id="vec_id")
    got = got.groupBy(F.col("query_id").alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("got"))
    rel = e.groupBy("label").agg(F.collect_list("vec_id").alias("rel"))
    x = got.join(e.select("vec_id", "label"), F.col("q") == F.col("vec_id")).join(rel, "label")
    g, r = F.col("got"), F.col("rel")
    return x.select("q", r6(M.recall_at_k(g, r, 5)).alias("recall"), r6(M.precision_at_k(g, r, 5)).alias("precision"), r6(M.f1_at_k(g, r, 5)).alias("f1"), r6(M.reciprocal_rank(g, r)).alias("reciprocal_rank"))


@query("tokenize", f"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, coalesce(w[1], '') AS first_token, coalesce(w[len(w)], '') AS last_token, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_TOK} AS w FROM documents)")
def tokenize(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    return d.select("doc_id", F.size("w").alias("n_tokens"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first_token"), F.coalesce(F.try_element_at("w", F.lit(-1)), F.lit("")).alias("last_token"), F.size(F.array_distinct("w")).alias("n_distinct"))


_IDF = "ln((1000 - 100 + 0.5) / (100 + 0.5))"


def _b(t: str, n: str) -> str:
    return f"{_IDF} * {t} * 2.5 / ({t} + 1.5 * (1 - 0.75 + 0.75 * {n} / 100.0))"


@query("bm25_fixed", f"SELECT doc_id, round({_b('a', 'n')} + {_b('b', 'n')}, 6) + 0.0 AS score FROM (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'the'))::DOUBLE AS b FROM (SELECT doc_id, {_TOK} AS w FROM documents))")
def bm25_fixed(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.tokens("text").alias("w"))
    return d.select("doc_id", r6(T.bm25_fixed("license the", F.col("w"))).alias("score"))


@query(
    "bm25_corpus",
    f"""WITH x AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'apache'))::DOUBLE AS b FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
    c AS (SELECT count(*) AS total, avg(n) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM x)
    SELECT doc_id, round(score, 6) + 0.0 AS score FROM (SELECT doc_id, ln(1 + (total - da + 0.5) / (da + 0.5)) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * n / avgdl)) + ln(1 + (total - db + 0.5) / (db + 0.5)) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * n / avgdl)) AS score FROM x, c) WHERE score > 0""",
)
def bm25_corpus(spark, sf_dir):
    return T.bm25(docs(spark, sf_dir), "Apache license", doc_id="doc_id", text="text").select("doc_id", r6(F.col("score")).alias("score"))


@query("chunk_fixed", "SELECT doc_id, CAST(k AS INTEGER) AS chunk_id, substr(text, s, 512) AS chunk_text, CAST(s AS INTEGER) AS start_pos, CAST(least(s + 511, length(text)) AS INTEGER) AS end_pos FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 384)) AS s, unnest(range(1, len(range(1, length(text) + 1, 384)) + 1)) AS k FROM documents WHERE length(text) > 0)")
def chunk_fixed(spark, sf_dir):
    return T.chunk(docs(spark, sf_dir), doc_id="doc_id", text="text")


@query("chunk_lines")
def chunk_lines(spark, sf_dir):
    """Packing is sequential; tested against brute force."""
    return T.chunk_at_separators(docs(spark, sf_dir), doc_id="doc_id", text="text", size=600, separator="\n")


@query("hash_embedding")
def hash_embedding(spark, sf_dir):
    """The built-in deterministic embedding; tested against a plain loop."""
    d = docs(spark, sf_dir).select("doc_id", T.embed_udf()(F.col("text")).alias("v"))
    return d.select("doc_id", F.size("v").alias("dims"), r6(F.element_at("v", 1)).alias("first"), r6(F.element_at("v", -1)).alias("last"))


@query("rag_query")
def rag_query(spark, sf_dir):
    """Chunks nearest to a question by the built-in embedding's cosine; a provider is an argument."""
    chunks = T.chunk(docs(spark, sf_dir), doc_id="doc_id", text="text")
    q = T.hash_embed(["what is the license"])[0]
    near = chunks.select(F.struct("doc_id", "chunk_id").alias("id"), "chunk_text", T.embed_distance(q)(F.col("chunk_text")).alias("distance"))
    near = near.filter("distance IS NOT NULL").orderBy("distance", "id").limit(5)
    return near.select("id.doc_id", "id.chunk_id", "chunk_text", r6(1 - F.col("distance")).alias("relevance_score"))
