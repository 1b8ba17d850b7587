"""Embeddings and language-model tasks through given providers, with a cache table and a job table.

There is no network here: a provider is a function that the caller passes in. Built-in ones are
deterministic stand-ins that need no model. Providers are called in Arrow batches on the
executors; a text that occurs often is sent once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrill.functions import vector as V
from vectrill.functions.text import hash_embed
from vectrill.operators import search

#: Texts to vectors: (texts, model, dims). Prompts to answers: (prompts, params).
Embedder = Callable[[Sequence[str | None], str, int], Sequence[Sequence[float] | None]]
Completer = Callable[[Sequence[str], dict], Sequence[str]]


# ---- embeddings


def embed(df: DataFrame, text: str, *, provider: Embedder = hash_embed, model: str = "", dims: int = 384, name: str = "embedding") -> DataFrame:
    """df with a vector of each text; null for a null text. Repeated texts of a batch are sent once."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = list(dict.fromkeys(x for x in s if x is not None and not pd.isna(x)))
            vectors = dict(zip(known, provider(known, model, dims)))
            yield pd.Series([vectors.get(x) for x in s], index=s.index)

    return df.withColumn(name, run(F.col(text)))


def embed_cached(df: DataFrame, text: str, cache: DataFrame, *, provider: Embedder = hash_embed, model: str = "", dims: int = 384, name: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(df with vectors, new cache rows). cache: (key, embedding), key = sha256 of model and text.
    Only distinct texts without a row go to the provider; the caller appends the new rows."""
    key = F.sha2(F.concat(F.lit(model + "\x00"), F.col(text)), 256)
    d = df.withColumn("_key", key)
    known = cache.select(F.col("key").alias("_key"), F.col("embedding").alias("_old"))
    todo = d.filter(F.col(text).isNotNull()).select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"]).join(known, "_key", "left_anti")
    new = embed(todo, "_text", provider=provider, model=model, dims=dims, name="_new").select("_key", "_new")
    every = known.unionByName(new.select("_key", F.col("_new").alias("_old")))
    out = d.join(every, "_key", "left").withColumnRenamed("_old", name).drop("_key")
    return out, new.select(F.col("_key").alias("key"), F.col("_new").alias("embedding"))


def cross_modal_search(df: DataFrame, vector: str, query: str, k: int = 10, *, provider: Embedder = hash_embed, model: str = "", dims: int = 384, id_col: str = "id", modality: str | None = None, wanted: str | None = None) -> DataFrame:
    """(id, score): the query, embedded by one modality's provider, against vectors of another in the same space."""
    d = df if modality is None else df.filter(F.col(modality) == wanted)
    q = provider([query], model, dims)[0]
    return search.knn(d, vector, q, k, metric="cosine", id_col=id_col).select("id", (1 - F.col("distance")).alias("score"))


# ---- tasks


def echo(prompts: Sequence[str], params: dict) -> list[str]:
    """The stand-in for a language model: the prompt's first words."""
    return [" ".join(p.split()[: params.get("max_tokens", 16)]) for p in prompts]


def complete(df: DataFrame, prompt: str, *, provider: Completer = echo, params: dict | None = None, name: str = "completion") -> DataFrame:
    """df with the provider's answer to each prompt; null for null. Answers are computed once a batch and text."""
    p = params or {}

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = list(dict.fromkeys(x for x in s if x is not None and not pd.isna(x)))
            out = dict(zip(known, provider(known, p)))
            yield pd.Series([out.get(x) for x in s], index=s.index)

    return df.withColumn(name, run(F.col(prompt)))


def summarize(df: DataFrame, text: str, *, sentences: int = 2, name: str = "summary") -> DataFrame:
    """Extractive: the sentences whose words are most frequent in the text, in their order."""

    def best(t: str) -> str:
        parts = [p for p in re.split(r"(?<=[.!?])\s+", t.strip()) if p]
        freq = Counter(re.findall(r"\w+", t.lower()))
        score = [sum(freq[w] for w in re.findall(r"\w+", p.lower())) / (len(p.split()) + 3) for p in parts]
        keep = sorted(sorted(range(len(parts)), key=lambda i: (-score[i], i))[:sentences])
        return " ".join(parts[i] for i in keep)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None or pd.isna(t) else best(t))

    return df.withColumn(name, run(F.col(text)))


def zero_shot(df: DataFrame, text: str, labels: Sequence[str], *, provider: Embedder = hash_embed, model: str = "", dims: int = 384) -> DataFrame:
    """df with label and score: the candidate whose embedding is nearest by cosine, the first on ties."""
    e = embed(df, text, provider=provider, model=model, dims=dims, name="_v")
    vectors = provider(list(labels), model, dims)
    s = [1 - V.cosine_distance("_v", v) for v in vectors]
    best = F.array_max(F.array(*s))
    label: Column = F.lit(None).cast("string")
    for name, x in reversed(list(zip(labels, s))):
        label = F.when(x == best, F.lit(name)).otherwise(label)
    return e.withColumn("label", label).withColumn("score", best).drop("_v")


def tokenize(df: DataFrame, text: str, tokenizer: str, *, max_length: int | None = 512, name: str = "token_ids") -> DataFrame:
    """df with token ids by a tokenizer file of the tokenizers library."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        for s in batches:
            ids = [e.ids[:max_length] for e in tok.encode_batch([x if isinstance(x, str) else "" for x in s])]
            yield pd.Series([i if isinstance(x, str) else None for i, x in zip(ids, s)], index=s.index)

    return df.withColumn(name, run(F.col(text)))


def detokenize(df: DataFrame, ids: str, tokenizer: str, *, name: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        for s in batches:
            yield pd.Series([None if x is None else tok.decode([int(i) for i in x]) for x in s], index=s.index)

    return df.withColumn(name, run(F.col(ids)))


# ---- jobs


def run_jobs(jobs: DataFrame, *, provider: Completer = echo, max_attempts: int = 3) -> DataFrame:
    """A job table (job_id, operation, input, tenant_id, status, attempts) after one round: queued jobs
    with attempts left are sent; each row comes back done with its result, or failed with the error."""

    @F.pandas_udf("struct<status:string,result:string,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            try:
                out.append(("done", provider([x or ""], {})[0], None))
            except Exception as e:  # a job's failure is its result
                out.append(("failed", None, str(e)[:500]))
        return pd.DataFrame(out, columns=["status", "result", "error"])

    due = (F.col("status") == "queued") & (F.col("attempts") < max_attempts)
    ran = jobs.filter(due).withColumn("_r", run("input")).withColumn("attempts", F.col("attempts") + 1)
    # a failed job with attempts left is queued again
    status = F.when((F.col("_r.status") == "failed") & (F.col("attempts") < max_attempts), "queued").otherwise(F.col("_r.status"))
    ran = ran.withColumn("status", status).select(*jobs.columns, F.col("_r.result").alias("result"), F.col("_r.error").alias("error"))
    kept = jobs.filter(~F.coalesce(due, F.lit(False))).select("*", F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error"))
    return ran.unionByName(kept)


def evict(cache: DataFrame, created: str, now, max_age_days: float | None = None, max_rows: int | None = None) -> DataFrame:
    """A cache table without stale rows, and with the newest max_rows at most."""
    if max_age_days is not None:
        cache = cache.filter(search.age_days(created, now) <= max_age_days)
    return cache if max_rows is None else cache.orderBy(F.desc(created), "key").limit(max_rows)
