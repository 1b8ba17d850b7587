"""Tokens, lexical scores, chunking and the built-in hash embedding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.operators.lineage import cut


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits, cut at 255 characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.substring(w, 1, 255))


def query_terms(query: str) -> list[str]:
    import re

    return sorted({w[:255] for w in re.findall("[a-z0-9]+", query.lower())})


def term_count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def matches_all(words: Column, query: str) -> Column:
    """Whether every query term occurs; plain tokens, without stemming."""
    out = F.lit(True)
    for t in query_terms(query):
        out = out & F.array_contains(words, t)
    return out


def text_rank(words: Column, query: str) -> Column:
    """Occurrences of query terms over 1 + the text's length, the build's own full-text rank."""
    total = F.lit(0)
    for t in query_terms(query):
        total = total + term_count(words, t)
    return total / (F.size(words) + 1)


def bm25_fixed(query: str, words: Column, k1: float = 1.5, b: float = 0.75, n: int = 1000, df: int = 100, avgdl: float = 100.0) -> Column:
    """BM25 of one text against assumed corpus figures."""
    idf = float(np.log((n - df + 0.5) / (df + 0.5)))
    out = F.lit(0.0)
    for t in query_terms(query):
        tf = term_count(words, t).cast("double")
        out = out + F.lit(idf) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size(words) / avgdl))
    return out


def bm25(df: DataFrame, query: str, *, doc_id: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of texts with a query term, by the corpus's own figures: ln(1 + (N - n + .5) / (n + .5)).

    Texts are read once: lengths and term counts, a few numbers a row, are checkpointed. A fixed
    number of sums over them (N, average length, each term's document count) scores the rows.
    """
    terms = query_terms(query)
    w = df.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("w"))
    w = w.select("doc_id", F.size("w").alias("len"), *[term_count(F.col("w"), t).alias(f"tf{i}") for i, t in enumerate(terms)])
    w = cut(w)
    sums = w.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    x = w.crossJoin(F.broadcast(sums))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, d = F.col(f"tf{i}").cast("double"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return x.select("doc_id", score.alias("score")).filter("score > 0")


def chunk(df: DataFrame, *, doc_id: str, text: str, size: int = 512, overlap: int = 128) -> DataFrame:
    """(doc_id, chunk_id from 1, chunk_text, start_pos from 1, end_pos) windows of characters."""
    if not size > overlap >= 0:
        raise ValueError("size must exceed overlap")
    step = size - overlap
    d = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter(F.length("t") > 0)
    d = d.select("doc_id", "t", F.posexplode_outer(F.sequence(F.lit(1), F.length("t"), F.lit(step))).alias("n", "start_pos"))
    return d.select("doc_id", (F.col("n") + 1).alias("chunk_id"), F.substring("t", F.col("start_pos"), F.lit(size)).alias("chunk_text"), "start_pos", F.least(F.col("start_pos") + size - 1, F.length("t")).alias("end_pos"))


def chunk_at_separators(df: DataFrame, *, doc_id: str, text: str, size: int = 512, separator: str = "\n\n") -> DataFrame:
    """Packs pieces between separators into chunks of at most size characters; longer pieces stay whole."""
    import re

    d = df.select(F.col(doc_id).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), re.escape(separator)).alias("p"))
    n = len(separator)
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["open"]) + n + F.length(p) <= size
        joined = F.when(a["open"].isNull(), p).when(fits, F.concat(a["open"], F.lit(separator), p)).otherwise(p)
        out = F.when(a["open"].isNull() | fits, a["out"]).otherwise(F.array_append(a["out"], a["open"]))
        return F.struct(out.alias("out"), joined.alias("open"))

    whole = F.aggregate("p", zero, step, lambda a: F.when(a["open"].isNull(), a["out"]).otherwise(F.array_append(a["out"], a["open"])))
    return d.select("doc_id", F.posexplode(whole).alias("n", "chunk_text")).filter("chunk_text != ''").select("doc_id", (F.col("n") + 1).alias("chunk_id"), "chunk_text")


def _hash_bytes(raw: Sequence[bytes]) -> np.ndarray:
    """Each text's hash: byte by byte, all texts that still have bytes at once; the last few one by one."""
    size = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = (np.cumsum(size) - size)[order]
    left = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")  # texts longer than each place
    h, done = np.full(len(raw), 5381, np.uint32), 0
    for place, n in enumerate(left.tolist()):
        if n < 32:
            break
        h[:n] = (h[:n] * np.uint32(33)) ^ data[begin[:n] + place]
        done = place + 1
    for k in range(len(raw)):
        if size[order[k]] <= done:
            break
        x = int(h[k])
        for byte in raw[order[k]][done:]:
            x = ((x * 33) ^ byte) & 0xFFFFFFFF
        h[k] = x
    out = np.empty(len(raw), np.uint32)
    out[order] = h
    return out


def hash_matrix(texts: Sequence[str | None], model: str = "", dims: int = 384) -> np.ndarray:
    """The built-in embeddings of texts as rows, None as the empty text."""
    name = model.encode()
    state = _hash_bytes([(t or "").encode() for t in texts])
    out = np.empty((dims, len(texts)), np.int16)
    for d in range(dims):
        state = (state * np.uint32(33)) ^ np.uint32(name[d % len(name)] if name else d & 0xFF)
        out[d] = state % np.uint32(2000)
    return (np.ascontiguousarray(out.T).astype(np.float64) - 1000) / 1000


def hash_embed(texts: Sequence[str | None], model: str = "", dims: int = 384) -> list[list[float] | None]:
    """The deterministic embedding that stands in where no model is given: a multiplicative hash
    of the bytes, then of each dimension's number or the model name's bytes, to [-1, 1)."""
    return [None if t is None else v for t, v in zip(texts, hash_matrix(texts, model, dims).tolist())]


#: Texts that a provider of embeddings is given at once.
EMBED_BATCH = 512


def embedded(provider, texts: Sequence[str | None], model: str, dims: int) -> list[np.ndarray | None]:
    """A provider's vectors of a few texts as arrays, eight bytes a number."""
    if provider is hash_embed:
        return [None if t is None else v for t, v in zip(texts, hash_matrix(texts, model, dims))]
    return [None if v is None else np.asarray(v, float) for v in provider(texts, model, dims)]


def embed_udf(provider=hash_embed, model: str = "", dims: int = 384):
    """An Arrow-batched column function around a provider of embeddings: texts to vectors. The provider is
    given EMBED_BATCH texts at a time, and its lists don't outlive them."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = []
            for c in range(0, len(s), EMBED_BATCH):
                out += embedded(provider, [None if pd.isna(x) else x for x in s.iloc[c : c + EMBED_BATCH]], model, dims)
            yield pd.Series(out, dtype=object)

    return embed


def embed_distance(query: Sequence[float], provider=hash_embed, model: str = "", dims: int = 384):
    """A column function from texts to the cosine distance of their embeddings from a query's, 1 where a norm
    is 0: the vectors stay in the task."""
    q = np.asarray(query, float)

    @F.pandas_udf("double")
    def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = []
            for c in range(0, len(s), EMBED_BATCH):
                vectors = embedded(provider, [None if pd.isna(x) else x for x in s.iloc[c : c + EMBED_BATCH]], model, dims)
                there = [v for v in vectors if v is not None]
                m = np.array(there, float).reshape(len(there), len(q))
                n = np.sqrt((m * m).sum(1)) * np.sqrt((q * q).sum())
                d = iter(np.where(n == 0, 1.0, 1 - (m * q).sum(1) / np.where(n == 0, 1, n)).tolist())
                out += [None if v is None else next(d) for v in vectors]
            yield pd.Series(out, dtype=object)

    return distance


def splade_like(text: Column | str, vocabulary: int = 30522) -> Column:
    """A sparse vector of hashed tokens weighted ln(1 + tf): map<int,double>."""
    t = tokens(text)
    ids = F.transform(t, lambda w: F.pmod(F.xxhash64(w), F.lit(vocabulary)).cast("int"))
    return F.map_from_entries(F.transform(F.array_distinct(ids), lambda i: F.struct(i.alias("key"), F.log1p(F.size(F.filter(ids, lambda j: j == i)).cast("double")).alias("value"))))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
