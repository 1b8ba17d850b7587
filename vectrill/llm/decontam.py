"""Benchmark decontamination with DataFrame functions only.

Test items become windows of normalised words. Their hashes form the broadcast side of one
join; training documents stream past it once. Every hash hit is verified word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrill.llm.common import Scratch, words

#: Windows in one broadcast, about 200 bytes each. A larger benchmark is matched in blocks of this size.
MAX_WINDOWS = 250_000


def _hash_at(w: Column, i: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(length)])


def _gram_at(w: Column, i: Column, length: Column) -> Column:
    return F.concat_ws(" ", F.slice(w, i + 1, length))


def benchmark_windows(bench: DataFrame, window: int = 8, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (h, len, gram, items): each distinct window with the sorted ids of its items."""
    w = F.col("_w")
    items = bench.select(F.col(item_id).cast("string").alias("_item"), words(F.col(text)).alias("_w")).filter(F.size(w) > 0)
    rows = items.select("_item", "_w", F.least(F.size(w), F.lit(window)).alias("len"), F.explode(F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))).alias("_i"))
    h = reduce(lambda other, n: F.when(F.col("len") == n, _hash_at(w, F.col("_i"), n)).otherwise(other), range(1, window), _hash_at(w, F.col("_i"), window))
    return rows.select(h.alias("h"), "len", _gram_at(w, F.col("_i"), F.col("len")).alias("gram"), "_item").groupBy("h", "len", "gram").agg(F.array_sort(F.collect_set("_item")).alias("items"))


def _spots(w: Column, n: int) -> Column:
    at = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), _hash_at(w, i, n).alias("h")))
    return F.when(F.size(w) >= n, at).otherwise(F.array().cast("array<struct<pos:int,len:int,h:bigint>>"))


def _hits(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """One row a document (pos -1) and one a verified hit, from one pass over the texts."""
    w = F.col("_w")
    spots = F.concat(
        F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("h"))),
        *[_spots(w, n) for n in lengths],
    )
    rows = docs.select("_uid", "_id", "_w", spots.alias("_s")).select("_uid", "_id", "_w", F.inline_outer("_s"))
    g = grams.select(F.col("h").alias("_h"), F.col("len").alias("_len"), "gram", "items")
    # inline_outer: the plain form infers a filter that would evaluate the whole array twice
    joined = rows.join(F.broadcast(g), rows["h"] == g["_h"], "left")
    same = (F.col("len") == F.col("_len")) & (_gram_at(w, F.col("pos"), F.col("len")) == F.col("gram"))
    return joined.filter((F.col("pos") == -1) | same).select(
        "_uid", "_id", "pos", F.when(F.col("pos") == -1, F.size(w)).alias("n"), F.when(F.col("pos") >= 0, F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))).alias("span"), F.when(F.col("pos") >= 0, F.col("items")).alias("items")
    )


def decontaminate(docs: DataFrame, bench: DataFrame, *, window: int = 8, min_items: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Reports, for each row of docs, the words that lie in any benchmark window.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged word
    ranges, end exclusive) and items. A null or empty text has no words and no hit; so has
    every text against an empty benchmark. Repeated rows are reported each by itself, null
    ids too. Extra columns are ignored. Windows of items shorter than `window` words are the
    whole item. The documents' side isn't shuffled: only hits and one row a document are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    grams = scratch.table(benchmark_windows(bench, window, item_id, item_text), "windows")
    stats = grams.groupBy("len").count().collect()  # at most `window` rows
    lengths, total = sorted(r["len"] for r in stats), sum(r["count"] for r in stats)
    src = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"))
    blocks = max(1, -(-total // max_windows))
    if blocks > 1:  # row ids must agree between the passes
        src = scratch.table(src.withColumn("_uid", F.monotonically_increasing_id()), "texts")
    else:
        src = src.withColumn("_uid", F.monotonically_increasing_id())
    src = src.select("_uid", "_id", words(F.col("_t")).alias("_w"))
    hits = reduce(DataFrame.unionByName, [_hits(src, grams if blocks == 1 else grams.filter(F.pmod("h", F.lit(blocks)) == b), lengths) for b in range(blocks)])
    per = hits.groupBy("_uid").agg(F.first("_id").alias("_id"), F.max("n").alias("n"), F.array_sort(F.collect_set("span")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.array().cast("array<struct<pos:int,end:int>>")
    merged = F.aggregate(
        "s",
        zero,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["pos"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["pos"].alias("pos"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    out = per.select("_id", "n", "items", F.when(F.size("s") > 0, merged).otherwise(zero).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["pos"]).cast("long"))
    return out.select(
        F.col("_id").alias("doc_id"), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"), "spans", "items",
    )


def query(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_W = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_W.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_W.format("text")} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
