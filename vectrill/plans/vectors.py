"""Queries over vector functions: distances, arithmetic, comparisons, batches, codecs, aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrill.functions import quant as Q
from vectrill.functions import vector as V
from vectrill.operators.aggregates import vector_aggregate
from vectrill.plans.registry import query, read

#: A fixed query vector of 64 dimensions.
PROBE = [round(((i * 37) % 64 - 31.5) / 256, 6) for i in range(64)]
OTHER = [round(((i * 23 + 5) % 64 - 30.0) / 256, 6) for i in range(64)]
PROBE_SQL, OTHER_SQL = ("([" + ", ".join(map(str, v)) + "]::DOUBLE[])" for v in (PROBE, OTHER))


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def emb(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


_Z = f"list_zip(e, {PROBE_SQL})"


def _s(expr: str, z: str = _Z) -> str:
    return f"list_sum(list_transform({z}, lambda z: {expr}))"


_BASE = "(SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_JAC = f"(SELECT vec_id, {_s('CASE WHEN abs(z[1]) > 0.1 AND abs(z[2]) > 0.05 THEN 1 ELSE 0 END')} AS i, {_s('CASE WHEN abs(z[1]) > 0.1 THEN 1 ELSE 0 END')} AS p, {_s('CASE WHEN abs(z[2]) > 0.05 THEN 1 ELSE 0 END')} AS q FROM {_BASE})"


@query(
    "vector_distances",
    f"""SELECT vec_id, round(sqrt({_s("(z[1]-z[2])*(z[1]-z[2])")}), 6) + 0.0 AS l2, round({_s("(z[1]-z[2])*(z[1]-z[2])")}, 6) + 0.0 AS squared_l2, round({_s("z[1]*z[2]")}, 6) + 0.0 AS inner_product,
    round(1 - {_s("z[1]*z[2]")} / (sqrt({_s("z[1]*z[1]")}) * sqrt({_s("z[2]*z[2]")})), 6) + 0.0 AS cosine, round({_s("abs(z[1]-z[2])")}, 6) + 0.0 AS l1, CAST({_s("CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END")} AS INTEGER) AS hamming,
    round(list_max(list_transform({_Z}, lambda z: abs(z[1]-z[2]))), 6) + 0.0 AS chebyshev, round(pow({_s("pow(abs(z[1]-z[2]), 3.0)")}, 1.0/3), 6) + 0.0 AS minkowski3, round(sqrt({_s("(z[1]-z[2])*(z[1]-z[2])*2.0")}), 6) + 0.0 AS mahalanobis FROM {_BASE}""",
)
def vector_distances(spark, sf_dir):
    e = "embedding"
    two = F.array_repeat(F.lit(2.0), 64)
    return emb(spark, sf_dir).select(
        "vec_id", r6(V.l2_distance(e, PROBE)).alias("l2"), r6(V.squared_l2_distance(e, PROBE)).alias("squared_l2"), r6(V.inner_product(e, PROBE)).alias("inner_product"), r6(V.cosine_distance(e, PROBE)).alias("cosine"),
        r6(V.l1_distance(e, PROBE)).alias("l1"), V.hamming_distance(e, PROBE).alias("hamming"), r6(V.chebyshev_distance(e, PROBE)).alias("chebyshev"), r6(V.minkowski_distance(e, PROBE, 3.0)).alias("minkowski3"), r6(V.mahalanobis_distance(e, PROBE, two)).alias("mahalanobis"),
    )


@query("vector_set_distances", f"SELECT vec_id, round(CASE WHEN p + q - i = 0 THEN 0 ELSE 1 - i / (p + q - i) END, 6) + 0.0 AS jaccard, round(CASE WHEN p + q = 0 THEN 0 ELSE 1 - 2 * i / (p + q) END, 6) + 0.0 AS dice FROM (SELECT vec_id, i::DOUBLE AS i, p::DOUBLE AS p, q::DOUBLE AS q FROM {_JAC})")
def vector_set_distances(spark, sf_dir):
    """Jaccard and Dice over elements of some size, the others zeroed first."""
    big = F.transform(V.vec("embedding"), lambda x: F.when(F.abs(x) > 0.1, x).otherwise(0.0))
    probe = V.vec([x if abs(x) > 0.05 else 0.0 for x in PROBE])
    d = emb(spark, sf_dir).select("vec_id", big.alias("a"), probe.alias("b"))
    return d.select("vec_id", r6(V.jaccard_distance("a", "b")).alias("jaccard"), r6(V.dice_distance("a", "b")).alias("dice"))


@query("vector_similarity", f"SELECT vec_id, round({_s('z[1]*z[2]')} / (sqrt({_s('z[1]*z[1]')}) * sqrt({_s('z[2]*z[2]')})), 6) + 0.0 AS cosine, round({_s('z[1]*z[2]')}, 6) + 0.0 AS dot, round(1 / (1 + sqrt({_s('(z[1]-z[2])*(z[1]-z[2])')})), 6) + 0.0 AS l2 FROM {_BASE}")
def vector_similarity(spark, sf_dir):
    return emb(spark, sf_dir).select("vec_id", *[r6(V.similarity("embedding", PROBE, m)).alias(m) for m in ("cosine", "dot", "l2")])


@query(
    "vector_math",
    f"""WITH n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x*x))) AS n, list_sum(e) / 64 AS m, list_sort(e) AS o FROM {_BASE})
    SELECT vec_id, CAST(len(e) AS INTEGER) AS dims, round(n, 6) + 0.0 AS norm, round(m, 6) + 0.0 AS mean, round(list_sum(list_transform(e, lambda x: (x-m)*(x-m))) / 64, 6) + 0.0 AS variance,
    round(sqrt(list_sum(list_transform(e, lambda x: (x-m)*(x-m))) / 64), 6) + 0.0 AS stddev, round(list_min(e), 6) + 0.0 AS minimum, round(list_max(e), 6) + 0.0 AS maximum, round(list_sum(e), 6) + 0.0 AS element_sum,
    round(o[32], 6) + 0.0 AS median, round(o[57], 6) + 0.0 AS p90, round(e[1] / n, 6) + 0.0 AS normalized_first, round(e[4], 6) + 0.0 AS third, round(list_sum(e[11:20]), 6) + 0.0 AS slice_sum FROM n""",
)
def vector_math(spark, sf_dir):
    e = "embedding"
    return emb(spark, sf_dir).select(
        "vec_id", V.dims(e).alias("dims"), r6(V.norm(e)).alias("norm"), r6(V.mean(e)).alias("mean"), r6(V.variance(e)).alias("variance"), r6(V.stddev(e)).alias("stddev"), r6(V.minimum(e)).alias("minimum"), r6(V.maximum(e)).alias("maximum"),
        r6(V.element_sum(e)).alias("element_sum"), r6(V.median(e)).alias("median"), r6(V.percentile(e, 0.9)).alias("p90"), r6(V.get(V.normalize(e), 0)).alias("normalized_first"), r6(V.get(e, 3)).alias("third"), r6(V.element_sum(V.slice_of(e, 10, 20))).alias("slice_sum"),
    )


_POS = "CAST(p - 1 AS INTEGER)"


@query(
    "vector_elementwise",
    f"""WITH m AS (SELECT vec_id, e, list_sum(e) / 64 AS m, list_min(e) AS lo, list_max(e) AS hi FROM {_BASE}), s AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: (x-m)*(x-m))) / 64) AS sd FROM m),
    x AS (SELECT vec_id, m, lo, hi, sd, unnest(range(1, 65)) AS p, unnest(e) AS v, unnest({PROBE_SQL}) AS q FROM s)
    SELECT vec_id, {_POS} AS pos, round(v + q, 6) + 0.0 AS added, round(v - q, 6) + 0.0 AS subtracted, round(v * 2.5, 6) + 0.0 AS scaled, round(v * q, 6) + 0.0 AS hadamard, round(abs(v), 6) + 0.0 AS absolute, round(v * v, 6) + 0.0 AS squared,
    round(sqrt(abs(v)), 6) + 0.0 AS rooted, round(pow(v, 3.0), 6) + 0.0 AS cubed, round(least(greatest(v, -0.1), 0.1), 6) + 0.0 AS clipped, round((v - m) / sd, 6) + 0.0 AS standardized, round((v - lo) / (hi - lo), 6) + 0.0 AS minmax, round(CASE WHEN q <> 0 THEN v ELSE 7.0 END, 6) + 0.0 AS chosen FROM x""",
)
def vector_elementwise(spark, sf_dir):
    e = "embedding"
    cols = {
        "added": V.add(e, PROBE), "subtracted": V.sub(e, PROBE), "scaled": V.mul(e, 2.5), "hadamard": V.hadamard(e, PROBE), "absolute": V.absolute(e), "squared": V.square(e), "rooted": V.square_root(V.absolute(e)), "cubed": V.power(e, 3.0),
        "clipped": V.clip(e, -0.1, 0.1), "standardized": V.standardize(e), "minmax": V.minmax_normalize(e), "chosen": V.where(PROBE, e, 7.0),
    }
    d = emb(spark, sf_dir).select("vec_id", *[c.alias(k) for k, c in cols.items()])
    # outer: the plain form infers a filter that evaluates the arrays twice
    d = d.select("vec_id", F.posexplode_outer(F.arrays_zip(*cols)).alias("pos", "z"))
    return d.select("vec_id", "pos", *[r6(F.col("z")[k]).alias(k) for k in cols])


@query(
    "vector_compare",
    f"""WITH p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT a_id, a = b AS eq, a <> b AS ne, a < b AS lt, a <= b AS le, a > b AS gt, a >= b AS ge, list_distance(a, {PROBE_SQL}) < list_distance(b, {PROBE_SQL}) AS l2_less,
    list_inner_product(a, {PROBE_SQL}) >= list_inner_product(b, {PROBE_SQL}) AS ip_ge, list_cosine_similarity(a, {PROBE_SQL}) > list_cosine_similarity(b, {PROBE_SQL}) AS cosine_less FROM p""",
)
def vector_compare(spark, sf_dir):
    a, b = emb(spark, sf_dir).select(F.col("vec_id").alias("a_id"), V.vec("embedding").alias("a")), emb(spark, sf_dir).select((F.col("vec_id") - 1).alias("b_id"), V.vec("embedding").alias("b"))
    p = a.join(b, F.col("a_id") == F.col("b_id"))
    return p.select("a_id", *[f("a", "b").alias(n) for n, f in (("eq", V.eq), ("ne", V.ne), ("lt", V.lt), ("le", V.le), ("gt", V.gt), ("ge", V.ge))], V.nearer("a", "b", PROBE, "l2", "<").alias("l2_less"), V.nearer("a", "b", PROBE, "inner_product", ">=").alias("ip_ge"), V.nearer("a", "b", PROBE, "cosine", "<").alias("cosine_less"))


_BOTH = f"[{PROBE_SQL}, {OTHER_SQL}]"


@query(
    "vector_batch",
    f"""SELECT vec_id, CAST(k - 1 AS INTEGER) AS nth, round(list_distance(q, e), 6) + 0.0 AS l2, round(1 - list_cosine_similarity(q, e), 6) + 0.0 AS cosine, round(list_inner_product(q, e), 6) + 0.0 AS inner_product
    FROM (SELECT vec_id, e, unnest([1, 2]) AS k, unnest({_BOTH}) AS q FROM {_BASE})""",
)
def vector_batch(spark, sf_dir):
    many = F.array(V.vec(PROBE), V.vec(OTHER))
    d = emb(spark, sf_dir).select("vec_id", *[V.distance_batch(many, "embedding", m).alias(m) for m in ("l2", "cosine", "inner_product")])
    d = d.select("vec_id", F.posexplode_outer(F.arrays_zip("l2", "cosine", "inner_product")).alias("nth", "z"))
    return d.select("vec_id", "nth", *[r6(F.col("z")[m]).alias(m) for m in ("l2", "cosine", "inner_product")])


@query("vector_batch_fold", f"SELECT vec_id, round(e[1] + {PROBE[0]} + {OTHER[0]}, 6) + 0.0 AS sum_first, round((e[64] + {PROBE[63]} + {OTHER[63]}) / 3, 6) + 0.0 AS avg_last FROM {_BASE}")
def vector_batch_fold(spark, sf_dir):
    many = F.array(V.vec("embedding"), V.vec(PROBE), V.vec(OTHER))
    return emb(spark, sf_dir).select("vec_id", r6(V.get(V.sum_batch(many), 0)).alias("sum_first"), r6(V.get(V.avg_batch(many), 63)).alias("avg_last"))


@query("vector_avg_by_label", "SELECT label, CAST(p - 1 AS INTEGER) AS pos, count(*) AS n, round(avg(v), 6) + 0.0 AS avg_value, round(sum(v), 5) + 0.0 AS sum_value FROM (SELECT label, unnest(range(1, 65)) AS p, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY label, p")
def vector_avg_by_label(spark, sf_dir):
    d = emb(spark, sf_dir)
    a, s = (vector_aggregate(d, "embedding", how, ["label"], 64, how) for how in ("avg", "sum"))
    both = a.join(s.drop("n"), "label")
    return both.select("label", "n", F.posexplode(F.arrays_zip("avg", "sum")).alias("pos", "z")).select("label", "pos", "n", r6(F.col("z.avg")).alias("avg_value"), (F.round("z.sum", 5) + F.lit(0.0)).alias("sum_value"))


@query("vector_cast", f"SELECT vec_id, round(e[2], 6) + 0.0 AS second, CAST(80 AS INTEGER) AS padded, 0.0::DOUBLE AS padding, CAST(16 AS INTEGER) AS cut, CAST(len(list_filter(e, lambda x: abs(x) > 0.1)) AS INTEGER) AS nnz, round(list_sum(list_filter(e, lambda x: abs(x) > 0.1)), 6) + 0.0 AS sparse_sum FROM {_BASE}")
def vector_cast(spark, sf_dir):
    big = F.transform(V.vec("embedding"), lambda x: F.when(F.abs(x) > 0.1, x).otherwise(0.0))
    d = emb(spark, sf_dir).select("vec_id", V.parse(V.to_text("embedding")).alias("t"), V.cast_dimension("embedding", 80).alias("p"), V.cast_dimension("embedding", 16).alias("c"), V.to_sparse(big).alias("s"))
    return d.select("vec_id", r6(V.get("t", 1)).alias("second"), F.size("p").alias("padded"), V.get("p", 79).alias("padding"), F.size("c").alias("cut"), F.size("s").alias("nnz"), r6(V.element_sum(F.map_values("s"))).alias("sparse_sum"))


_SP = "list_transform(e, lambda x: CASE WHEN abs(x) > 0.1 THEN x ELSE 0.0 END)"


@query(
    "sparse_distances",
    f"""WITH a AS (SELECT vec_id, {_SP} AS a FROM {_BASE}), p AS (SELECT x.vec_id, x.a AS a, y.a AS b FROM a x JOIN a y ON y.vec_id = x.vec_id + 1)
    SELECT vec_id, round(list_distance(a, b), 6) + 0.0 AS l2, round(list_inner_product(a, b), 6) + 0.0 AS inner_product, round(1 - list_cosine_similarity(a, b), 6) + 0.0 AS cosine, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1]-z[2]))), 6) + 0.0 AS l1, round(sqrt(list_inner_product(a, a)), 6) + 0.0 AS norm FROM p""",
)
def sparse_distances(spark, sf_dir):
    big = F.transform(V.vec("embedding"), lambda x: F.when(F.abs(x) > 0.1, x).otherwise(0.0))
    d = emb(spark, sf_dir).select("vec_id", V.to_sparse(big).alias("s"))
    p = d.select("vec_id", F.col("s").alias("a")).join(d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", r6(V.sparse_l2_distance(a, b)).alias("l2"), r6(V.sparse_inner_product(a, b)).alias("inner_product"), r6(V.sparse_cosine_distance(a, b)).alias("cosine"), r6(V.sparse_l1_distance(a, b)).alias("l1"), r6(V.sparse_norm(a)).alias("norm"))


@query(
    "quantize_codes",
    f"""WITH b AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS m, list_min(e) AS lo, list_max(e) AS hi FROM {_BASE}),
    x AS (SELECT vec_id, m, lo, hi, unnest(range(1, 65)) AS p, unnest(e) AS v FROM b)
    SELECT vec_id, {_POS} AS pos, CAST(round_even(v * 127.0 / m, 0) AS INTEGER) AS int8, CAST(round_even((v - lo) * 255.0 / (hi - lo), 0) AS INTEGER) AS uint8, CAST(round_even(v * 7.0 / m, 0) AS INTEGER) + 8 AS int4,
    CAST(CASE WHEN v > m / 3.0 THEN 2 WHEN v < -(m / 3.0) THEN 1 ELSE 0 END AS INTEGER) AS ternary, CAST(v > 0 AS INTEGER) AS bits, round(round_even(v * 127.0 / m, 0) / 127.0, 6) + 0.0 AS decoded FROM x""",
)
def quantize_codes(spark, sf_dir):
    kinds = {"int8": "int8", "uint8": "uint8", "int4": "int4", "ternary": "ternary", "bits": "binary"}
    d = emb(spark, sf_dir).select("vec_id", *[Q.quantize("embedding", m).alias(k) for k, m in kinds.items()])
    d = d.withColumn("decoded", Q.from_int8(F.col("int8")))
    d = d.select("vec_id", F.posexplode_outer(F.arrays_zip(*kinds, "decoded")).alias("pos", "z"))
    return d.select("vec_id", "pos", *[F.col("z")[k].cast("int").alias(k) for k in kinds], r6(F.col("z.decoded")).alias("decoded"))


@query(
    "quantize_analyze",
    f"""WITH b AS (SELECT vec_id, e, list_max(list_transform(e, lambda x: abs(x))) AS m FROM {_BASE}), d AS (SELECT vec_id, e, list_transform(e, lambda x: abs(x - round_even(x * 127.0 / m, 0) / 127.0 * m)) AS err FROM b)
    SELECT vec_id, round(list_sum(list_transform(err, lambda x: x*x)) / 64 * 1e6, 4) + 0.0 AS mse_millionths, round(list_sum(err) / 64, 6) + 0.0 AS mae, round(list_max(err), 6) + 0.0 AS max_error, 4.0::DOUBLE AS compression_ratio, round(list_sum(err) / 64 / list_sum(list_transform(e, lambda x: abs(x))), 8) + 0.0 AS relative_error FROM d""",
)
def quantize_analyze(spark, sf_dir):
    d = emb(spark, sf_dir).select("vec_id", Q.analyze("embedding", "int8").alias("a"))
    return d.select("vec_id", (F.round(F.col("a.mse") * 1e6, 4) + F.lit(0.0)).alias("mse_millionths"), r6(F.col("a.mae")).alias("mae"), r6(F.col("a.max_error")).alias("max_error"), F.col("a.compression_ratio").alias("compression_ratio"), (F.round("a.relative_error", 8) + F.lit(0.0)).alias("relative_error"))


@query("binary_hamming", f"SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS packed, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS plain FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def binary_hamming(spark, sf_dir):
    d = emb(spark, sf_dir).select("vec_id", Q.to_binary("embedding").alias("bits")).withColumn("packed", Q.pack_bits(F.col("bits")))
    o = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("b2"), F.col("packed").alias("p2"))
    return d.join(o, "vec_id").select("vec_id", Q.packed_hamming(F.col("packed"), F.col("p2")).alias("packed"), Q.bit_hamming(F.col("bits"), F.col("b2")).alias("plain"))


@query(
    "half_precision",
    f"""WITH x AS (SELECT vec_id, unnest(range(1, 65)) AS p, unnest(e) AS v FROM {_BASE}), y AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE floor(log2(abs(v))) END AS ex FROM x)
    SELECT vec_id, {_POS} AS pos, {", ".join(f"round(CASE WHEN v = 0 OR ex < {lo} THEN 0.0 ELSE sign(v) * floor(abs(v) / pow(2.0, ex - {b})) * pow(2.0, ex - {b}) END, 9) + 0.0 AS {n}" for n, b, lo in (("fp16", 10, -14), ("e4m3", 3, -6), ("e5m2", 2, -14)))} FROM y""",
)
def half_precision(spark, sf_dir):
    d = emb(spark, sf_dir).select("vec_id", Q.to_fp16("embedding").alias("fp16"), Q.to_fp8_e4m3("embedding").alias("e4m3"), Q.to_fp8_e5m2("embedding").alias("e5m2"))
    d = d.select("vec_id", F.posexplode_outer(F.arrays_zip("fp16", "e4m3", "e5m2")).alias("pos", "z"))
    return d.select("vec_id", "pos", *[(F.round(F.col("z")[k], 9) + F.lit(0.0)).alias(k) for k in ("fp16", "e4m3", "e5m2")])
