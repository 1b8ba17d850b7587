"""Values of column functions, against numbers worked out by hand or by plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrill.functions import irmetrics as M
from vectrill.functions import quant as Q
from vectrill.functions import text as T
from vectrill.functions import vector as V


def one(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return list(r) if len(cols) > 1 else r[0]


A, B = [0.0, 0.0], [3.0, 4.0]


def test_distances(spark):
    got = one(spark, V.l2_distance(A, B), V.l2_distance(A, A), V.cosine_distance(A, B), V.inner_product(B, B), V.l1_distance(A, B), V.hamming_distance(A, B), V.chebyshev_distance(A, B), V.minkowski_distance(A, B, 3.0), V.similarity(B, B, "dot"))
    assert got[:7] == [5.0, 0.0, 1.0, 25.0, 7.0, 2, 4.0]
    assert math.isclose(got[7], (27 + 64) ** (1 / 3)) and got[8] == 25.0


def test_unrolled_and_folded_forms_agree(spark):
    e = F.array(*[F.lit(float(i)) for i in range(5)])
    q = [1.0, -2.0, 0.5, 0.0, 3.0]
    for f in (V.l2_distance, V.inner_product, V.cosine_distance, V.l1_distance, V.jaccard_distance, V.dice_distance):
        a, b = one(spark, f(e, q), f(e, V.vec(q)))
        assert math.isclose(a, b, abs_tol=1e-12)


def test_edges_of_distances(spark):
    short = F.array(F.lit(1.0))
    null = F.lit(None).cast("array<double>")
    got = one(spark, V.l2_distance(short, B), V.l2_distance(null, B), V.cosine_distance(short, B), V.dice_distance(A, A), V.dice_distance(A, B), V.jaccard_distance(A, A), V.eq(short, B), V.lt(short, B))
    assert got == [None, None, None, 0.0, 1.0, 0.0, False, False]
    with pytest.raises(ValueError):
        V.minkowski_distance(A, B, 0)


def test_math(spark):
    v = F.array(*[F.lit(x) for x in (3.0, 1.0, 2.0)])
    assert one(spark, V.cross_product(F.array(*map(F.lit, (1.0, 0.0, 0.0))), F.array(*map(F.lit, (0.0, 1.0, 0.0))))) == [0.0, 0.0, 1.0]
    assert one(spark, V.set_at(v, 1, 9.0)) == [3.0, 9.0, 2.0]
    assert one(spark, V.slice_of(v, 1, 3)) == [1.0, 2.0]
    assert one(spark, V.prepend(0.0, V.append(v, 4.0))) == [0.0, 3.0, 1.0, 2.0, 4.0]
    assert one(spark, V.filter_mask(v, F.array(F.lit(True), F.lit(False), F.lit(True)))) == [3.0, 2.0]
    assert one(spark, V.standardize(F.array(F.lit(2.0), F.lit(2.0)))) == [0.0, 0.0]
    assert one(spark, V.minmax_normalize(F.array(F.lit(2.0), F.lit(2.0)))) == [0.5, 0.5]
    assert one(spark, V.quantile(v, [0.0, 0.5, 1.0])) == [1.0, 2.0, 3.0]
    assert one(spark, V.normalize(A)) == [0.0, 0.0]
    assert one(spark, V.parse(F.lit("{1,2.5}"))) == [1.0, 2.5]
    assert one(spark, V.to_text(F.array(F.lit(1.0), F.lit(2.5)))) == "[1,2.5]"
    with pytest.raises(Exception, match="expected 3 dimensions"):
        one(spark, V.checked(A, 3))


def test_codecs(spark):
    v = F.array(*[F.lit(x) for x in (-1.0, 0.5, 0.25, 0.0)])
    assert one(spark, Q.to_int8(v)) == [-127, 64, 32, 0]  # 63.5 and 31.75, half to even
    assert one(spark, Q.to_int4(v)) == [1, 12, 10, 8]
    assert one(spark, Q.to_ternary(v)) == [1, 2, 0, 0]
    assert one(spark, Q.to_binary(v)) == [0, 1, 1, 0]
    assert one(spark, Q.to_int8(A)) == [0, 0]
    assert one(spark, Q.pack_bits(Q.to_binary(v))) == [6]
    h = one(spark, Q.to_fp16(F.array(F.lit(0.1), F.lit(1e-9), F.lit(1e9))))
    assert h[0] == 0.0999755859375 and h[1] == 0.0 and h[2] == 65504.0
    lo, hi = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, Q.dequantize_between(Q.quantize_between(F.array(F.lit(0.0), F.lit(1.0)), lo, hi), lo, hi)) == [0.0, 1.0]


def test_metrics(spark):
    got, rel = F.array(*map(F.lit, (5, 3, 9, 1))), F.array(*map(F.lit, (3, 1, 7)))
    r = one(spark, M.recall_at_k(got, rel, 2), M.precision_at_k(got, rel, 2), M.f1_at_k(got, rel, 2), M.reciprocal_rank(got, rel), M.precision_at_k(got, rel, 99), M.recall_at_k(got, F.array().cast("array<int>")))
    assert [round(x, 6) for x in r] == [0.333333, 0.5, 0.4, 0.5, 0.5, 0.0]


def test_text(spark):
    assert one(spark, T.tokens(F.lit("The MIT-License, 2.0 été"))) == ["the", "mit", "license", "2", "0", "t"]
    d = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "id int, t string")
    rows = [tuple(r) for r in T.chunk(d, doc_id="id", text="t", size=4, overlap=1).orderBy("chunk_id").collect()]
    assert rows == [(1, 1, "abcd", 1, 4), (1, 2, "defg", 4, 7), (1, 3, "ghij", 7, 10), (1, 4, "j", 10, 10)]
    with pytest.raises(ValueError):
        T.chunk(d, doc_id="id", text="t", size=4, overlap=4)


def brute_chunks(t, size, sep):
    out, open_ = [], None
    for p in t.split(sep):
        if open_ is None:
            open_ = p
        elif len(open_) + len(sep) + len(p) <= size:
            open_ += sep + p
        else:
            out.append(open_)
            open_ = p
    return [x for x in [*out, open_] if x]


def test_chunks_at_separators(spark):
    texts = ["a\n\nbb\n\nccc", "", "x" * 30, "\n\n".join("w" * (i % 7) for i in range(40))]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in T.chunk_at_separators(d, doc_id="id", text="t", size=9).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk_text"])
    assert got == {i: c for i, t in enumerate(texts) if (c := brute_chunks(t, 9, "\n\n"))}


def test_hash_embedding(spark):
    def plain(text, dims):
        h = 5381
        for b in text.encode():
            h = ((h * 33) ^ b) & 0xFFFFFFFF
        out = []
        for i in range(dims):
            h = ((h * 33) ^ (i & 0xFF)) & 0xFFFFFFFF
            out.append((h % 2000 - 1000) / 1000)
        return out

    assert T.hash_embed(["abc", None, ""], dims=8) == [plain("abc", 8), None, plain("", 8)]
    assert np.allclose(one(spark, T.embed_udf(dims=8)(F.lit("abc"))), plain("abc", 8))


def test_embeddings_are_made_a_few_texts_at_a_time(spark, monkeypatch):
    """Texts of many lengths give the plain loop's hash; a provider never holds a whole batch of lists."""
    texts = ["", None, "é" * 7, "x" * 5000] + ["ab" * i for i in range(120)]
    want = []
    for t in texts:
        h = 5381
        for b in (t or "").encode():
            h = ((h * 33) ^ b) & 0xFFFFFFFF
        want.append(h)
    assert T._hash_bytes([(t or "").encode() for t in texts]).tolist() == want
    sizes = []

    def provider(texts, model, dims):
        sizes.append(len(texts))
        return T.hash_embed(texts, model, dims)

    out = T.embed_udf(provider, dims=4).func(iter([__import__("pandas").Series(["a", None] * 2000)]))
    assert sum(len(s) for s in out) == 4000 and max(sizes) <= 512
    df = spark.createDataFrame([("a",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.embed_udf(dims=4)("t")).collect()] == T.hash_embed(["a", None, ""], dims=4)


def test_distances_of_texts_are_those_of_their_embeddings(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["what is the license", "a", "", None, "license " * 60])], "id int, t string")
    q = T.hash_embed(["what is the license"])[0]
    both = df.select("id", T.embed_distance(q)("t").alias("d"), V.cosine_distance(T.embed_udf()("t"), q).alias("e"))
    rows = both.collect()
    assert all((r["d"] is None) == (r["e"] is None) and (r["d"] is None or abs(r["d"] - r["e"]) < 1e-12) for r in rows)
    assert [r["id"] for r in rows if r["d"] is None] == [3] and abs(rows[0]["d"]) < 1e-12
