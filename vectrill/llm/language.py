"""Language identification with string kernels.

A text's blended spectrum is the set of its byte n-grams of length 1 to 4, hashed to a fixed
number of presence features. The kernel is the cosine of two such sets. A Nystrom map over
landmark texts turns it into a short vector, on which one ridge regression a language is
fitted, one language against the rest. Whole batches are scored by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.llm.common import Scratch, fold

FEATURES, LENGTHS = 1 << 14, 4
#: The labelled rows that train it: at most so many a language and in all, those with the smallest hash of their id.
PER_LANGUAGE, SAMPLE = 500, 4_000
LANDMARKS, RIDGE, SHARPNESS = 128, 1e-2, 6.0
_TABLE = np.random.default_rng(5).integers(0, 1 << 16, (LENGTHS, 256), dtype=np.uint16)
_SALT = np.array([0, 0x5BD1, 0xA3C7, 0x1E35], np.uint16)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def presence(texts: list[bytes], size: int = FEATURES) -> np.ndarray:
    """0/1 rows: which hashed n-grams each text has."""
    out = np.zeros((len(texts), size), np.uint8)
    for row, t in zip(out, texts):
        b = _LOWER[np.frombuffer(t, np.uint8)]
        h = np.zeros(len(b), np.uint16)
        for n in range(min(LENGTHS, len(b))):
            h = h[: len(b) - n] + _TABLE[n][b[n:]]
            row[(h ^ _SALT[n]) & np.uint16(size - 1)] = 1
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # features by landmarks, each of unit length
    weights: np.ndarray  # landmarks by languages: inverse root of the landmarks' kernel times the regressions
    bias: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Softmax of the regressions, a row a text."""
        x = presence(texts).astype(np.float32)
        k = x @ self.landmarks / np.sqrt(np.maximum(x.sum(1), 1))[:, None]
        z = SHARPNESS * (k @ self.weights + self.bias)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for i in range(0, len(texts), 256):
            bits = np.packbits(presence(texts[i : i + 256]), axis=1)
            yield pa.record_batch({"lang": batch.column("lang").slice(i, 256), "order": batch.column("order").slice(i, 256), "bits": pa.array([b.tobytes() for b in bits], pa.binary())})


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Learns from text and non-null lang of rows outside fold 0. Without such rows it knows no language."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & F.col("_id").isNotNull() & (fold(F.col("_id")) != 0)).withColumn("order", F.xxhash64("_id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # a row stays for ranking if its hash is in the lowest share that should hold four times the quota
    unit = F.shiftrightunsigned("order", 1) / float(1 << 63)
    cut = rows.join(sizes, "lang").filter(unit * F.col("n") <= 4.0 * per_language + 20).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.shiftrightunsigned("order", 1), "_id")))
    picked = scratch.table(cut.filter(F.col("rank") <= per_language).orderBy("rank", "lang").limit(sample).select(F.col("_id").alias("_p"), F.col("lang").alias("_lang"), "order"), "picked")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), (F.col("_id") == F.col("_p")) & (F.col("lang") == F.col("_lang")))
    got = texts.select("lang", "order", "text").mapInArrow(_packed, "lang string, order long, bits binary").toArrow()
    scratch.drop(picked)
    langs, order, bits = got.column("lang").to_pylist(), got.column("order").to_pylist(), got.column("bits").to_pylist()
    seq = sorted(range(len(langs)), key=lambda i: (order[i], langs[i], bits[i]))
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((FEATURES, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    x = np.unpackbits(np.frombuffer(b"".join(bits[i] for i in seq), np.uint8).reshape(len(seq), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]
    y = np.array([names.index(langs[i]) for i in seq])
    by = [np.flatnonzero(y == c) for c in range(len(names))]
    turn = [r[k] for k in range(max(map(len, by))) for r in by if k < len(r)][:landmarks]
    marks = x[turn]
    val, vec = np.linalg.eigh((marks @ marks.T).astype(float))
    root = vec * (1 / np.sqrt(np.maximum(val, 1e-6)))
    phi = (x @ marks.T) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean, tmean = phi.mean(0), target.mean(0)
    z = phi - mean
    w = np.linalg.solve(z.T @ z + RIDGE * len(x) * np.eye(len(mean)), z.T @ (target - tmean))
    return Model(names, np.ascontiguousarray(marks.T), (root @ w).astype(np.float32), (tmean - mean @ w).astype(np.float32))


def _predict(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i in range(0, len(texts), 256):
                some = texts[i : i + 256]
                p = model.score([(t or "").encode() for t in some])
                best = p.argmax(1)
                known = [bool(model.languages) and t is not None and any(map(str.isalpha, t)) for t in some]
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(i, 256), "held_out": batch.column("held_out").slice(i, 256),
                    "lang_pred": pa.array([model.languages[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                    "score": pa.array([float(min(p[j, b], 1.0)) if k else 0.0 for j, (b, k) in enumerate(zip(best, known))], pa.float64()),
                })

    return run


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    A text that is null or has no letter is `und` with score 0; so is every text if no row has
    a language to learn from. Repeated rows are predicted each; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, doc_id=doc_id, text=text, lang=lang, **options))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(F.col(doc_id)) == 0).alias("held_out"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_predict(held), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir):
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
