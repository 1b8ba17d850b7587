"""Rerankers: linear, ensembles, late interaction, and model-backed ones with a given scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.functions import text as T
from vectrill.operators.search import minmax

#: Scores texts against a query: (query, texts) -> numbers.
Scorer = Callable[[str, Sequence[str]], Sequence[float]]


def overlap_scorer(query: str, texts: Sequence[str]) -> list[float]:
    """The built-in scorer where no model is given: share of the query's words that a text has."""
    import re

    q = set(re.findall("[a-z0-9]+", query.lower()))
    return [len(q & set(re.findall("[a-z0-9]+", (t or "").lower()))) / max(len(q), 1) for t in texts]


def rerank(df: DataFrame, query: str, text: str, *, scorer: Scorer = overlap_scorer, top_k: int = 10, id_col: str = "id", max_tokens: int | None = None) -> DataFrame:
    """(rank, id, score) by a model's scores, in Arrow batches. max_tokens cuts texts at four characters a token."""

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in scorer(query, [x or "" for x in t])], dtype="float64")

    t = F.coalesce(F.col(text), F.lit(""))
    t = t if max_tokens is None else F.substring(t, 1, 4 * max_tokens)
    top = df.select(F.col(id_col).alias("id"), score(t).alias("score")).orderBy(F.desc("score"), "id").limit(top_k)
    return top.select(F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"), "id", "score")


def ltr(df: DataFrame, features: Sequence[str], weights: Sequence[float], bias: float = 0.0, *, id_col: str = "id") -> DataFrame:
    """(id, score): a linear model over feature columns."""
    s = F.lit(float(bias))
    for f, w in zip(features, weights, strict=True):
        s = s + F.col(f) * float(w)
    return df.select(F.col(id_col).alias("id"), s.alias("score"))


def weighted_ensemble(df: DataFrame, systems: Sequence[str], weights: Sequence[float] | None = None, *, normalize: bool = True, id_col: str = "id") -> DataFrame:
    """(id, score): weights over their sum times each system's scores, scaled by their extremes."""
    w = list(weights) if weights is not None else [1.0] * len(systems)
    d = df.select(F.col(id_col).alias("id"), *[F.col(s).cast("double").alias(s) for s in systems])
    d = minmax(d, *systems) if normalize else d
    return d.select("id", sum((F.col(s) * (x / sum(w)) for s, x in zip(systems, w)), F.lit(0.0)).alias("score"))


def borda(lists: DataFrame, *, list_id: str = "list", id_col: str = "id", rank_col: str = "rank") -> DataFrame:
    """(id, points) from ranked lists (list, id, rank from 1): list length minus rank from 0. Ids below 1 are padding."""
    x = lists.select(F.col(list_id).alias("l"), F.col(id_col).alias("id"), F.col(rank_col).alias("r")).filter("id > 0")
    size = x.groupBy("l").agg(F.max("r").alias("n"))
    return x.join(size, "l").groupBy("id").agg(F.sum(F.col("n") - F.col("r") + 1).alias("points"))


def colbert(query: Column, tokens: Column) -> Column:
    """Late interaction of two arrays of token vectors: each query vector's best dot product, summed."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = F.transform(query, lambda q: F.array_max(F.transform(tokens, lambda t: dot(q, t))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def rank_by_edit(df: DataFrame, query: str, text: str, k: int = 10, *, id_col: str = "id") -> DataFrame:
    """(id, score) by edit similarity to the query."""
    return df.select(F.col(id_col).alias("id"), T.edit_similarity(F.coalesce(F.col(text), F.lit("")), F.lit(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k)
