"""Toxicity by class-conditional Kneser-Ney word models.

Two models, of toxic and of ordinary labelled texts, give each word of a document two
probabilities. With N(w) the distinct words that w follows in a class,

    P(w) = max(N(w) - D, 0) / N + l S(w),   N = sum of N(w),   l = sum of min(N(w), D) / N

where S, shared by the classes, follows the word counts of all documents. Every word keeps its
counts; rare ones lean on the shared distribution by the discount alone. As N(w) counts
contexts, not places, copies of one text count once. A document's log-likelihoods are compared
by its length, and so are those of its passages of a few words, of which the most toxic one
counts. Both figures are calibrated on labelled rows that the models haven't seen.

This is Kneser-Ney's lower order. A level of word pairs above it was tried, with each class's
own weights: what near copies of long texts have in common then outweighs the words (figures
in the README).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.llm.common import Scratch, fold, slices
from vectrill.llm.grams import blocks, hashes, word_ids

#: At most so many labelled rows of each class train the models, and so many calibrate them; those
#: with the smallest hash of their id are taken.
PER_CLASS, CALIBRATE = 5_000, 5_000
#: What may be taken off the number of a word's left words; the calibrating rows choose. Large ones are needed
#: where copies of texts and passages that many share make words frequent in one class by chance.
DISCOUNTS = (1.0, 2.0, 5.0, 10.0)
#: Words of a passage.
PASSAGE = 4
#: Distinct words that a task counts before it passes them on.
HOLD = 250_000
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and where each text's begin (one more at the end)."""
    parts, bounds = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    done = 0
    for i, j in blocks(texts):
        ids, words, at = word_ids(texts[i:j], _WORD)
        parts.append(hashes(words)[ids])
        bounds.append(at[1:] + done)
        done += len(ids)
    return np.concatenate(parts), np.concatenate(bounds)


def left_words(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each, 0 at a text's start."""
    left = np.concatenate([[np.uint64(0)], h[:-1]]).astype(np.uint64)[: len(h)]
    starts = bounds[:-1]
    left[starts[starts < len(h)]] = 0
    return left


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (left word, word) and which classes have them."""
    for batch in slices(batches):
        h, bounds = word_hashes(_texts(batch, "text"))
        left = left_words(h, bounds)
        toxic = np.repeat(np.array(batch.column("toxic").to_pylist(), bool), np.diff(bounds))
        order = np.lexsort((left, h))
        u, w, t = left[order], h[order], toxic[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 0) | (np.diff(u) != 0)])[: len(w)])
        if len(first):
            yield pa.record_batch({"u": pa.array(u[first].view(np.int64)), "w": pa.array(w[first].view(np.int64)), "in0": pa.array(np.logical_or.reduceat(~t, first)), "in1": pa.array(np.logical_or.reduceat(t, first))})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of all texts and how often each occurs, summed within a task up to a bound."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.record_batch({"w": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    for batch in slices(batches, 500):
        h, _ = word_hashes(_texts(batch, "text"))
        k, n = np.unique(h, return_counts=True)
        both, which = np.unique(np.concatenate([keys, k]), return_inverse=True)
        keys, counts = both, np.bincount(which, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
        if len(keys) > HOLD:
            yield out()
            keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    yield out()


@dataclass
class Model:
    """The log ratio, toxic to ordinary, of each word of either class, by its ascending hash."""

    words: np.ndarray
    ratio: np.ndarray
    other: float  # of a word of neither class
    weights: np.ndarray  # of the calibration: intercept, then one a feature
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def ratios(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The log ratio of each word of all texts, and where each text's words begin."""
        h, bounds = word_hashes(texts)
        if not len(self.words):
            return np.full(len(h), self.other), bounds
        some, which = np.unique(h, return_inverse=True)  # ascending queries stay in the processor's cache
        at = np.minimum(np.searchsorted(self.words, some), len(self.words) - 1)
        return np.where(self.words[at] == some, self.ratio[at], self.other)[which], bounds

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The difference of log-likelihoods a word, of the text and of its most toxic passage; zeros without words."""
        each, bounds = self.ratios(texts)
        n = np.diff(bounds)
        upto = np.concatenate([[0.0], np.cumsum(each)])
        x = np.zeros((len(n), 2))
        x[:, 0] = (upto[bounds[1:]] - upto[bounds[:-1]]) / np.maximum(n, 1)
        size = np.minimum(n, PASSAGE)
        full = np.flatnonzero(n > 0)
        if len(full):
            text = np.repeat(np.arange(len(n)), n)
            end = np.arange(len(each)) + size[text]
            inside = end <= bounds[1:][text]
            mean = np.where(inside, (upto[np.minimum(end, len(each))] - upto[:-1]) / size[text], -np.inf)
            x[full, 1] = np.maximum.reduceat(mean, bounds[:-1][full])
        return x

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:], -40, 40)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.chance(self.features(texts)) if len(self.weights) else np.full(len(texts), self.prior)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (intercept first), means and scales, by Newton's method with a ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    ridge = penalty * np.diag([0.0] + [1.0] * x.shape[1]) + 1e-6 * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def _column(df: DataFrame, *names: str) -> list[np.ndarray]:
    t = df.select(*names).toArrow()
    return [t.column(c).to_numpy() for c in names]


def class_counts(pairs: DataFrame, shared: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hashes of the words of either class, ascending; N(w) of both classes; S(w); words of all
    documents). pairs: distinct u, w with in0 and in1; shared: w, n over all documents."""
    follows = pairs.groupBy("w").agg(*[F.count_if(f"in{c}").alias(f"n{c}") for c in (0, 1)])
    total, kinds = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    w, n0, n1, n = _column(follows.join(shared, "w", "left").select("w", "n0", "n1", F.coalesce("n", F.lit(0)).alias("n")), "w", "n0", "n1", "n")
    order = np.argsort(w.view(np.uint64))
    return w.view(np.uint64)[order], np.array([n0, n1], float)[:, order], (n[order] + 1) / (total + kinds + 1), total


def log_ratios(n: np.ndarray, back: np.ndarray, discount: float) -> tuple[np.ndarray, float]:
    """The log ratio of each word of either class, and that of any other."""
    rest = np.minimum(n, discount).sum(1) / n.sum(1)
    p = np.maximum(n - discount, 0) / n.sum(1)[:, None] + rest[:, None] * back
    return np.log(p[1] / p[0]), float(np.log(rest[1] / rest[0]))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, calibrate: int = CALIBRATE) -> Model:
    """Learns from labelled rows outside fold 0: folds 1 to 3 train the models, as many of either
    class; fold 4 calibrates.

    The shared counts are of every word of all docs, in a written table. The model holds every
    word of the bounded sample. Null labels, labels other than 0 and 1, and labels of no
    document are ignored; of several labels of one document the largest counts. With one class
    only, every score is that class; without labels, 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_l")).agg(F.max(label).cast("int").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("_l"))).withColumn("_o", F.xxhash64("_l")).filter("fold != 0")
    known = scratch.table(known, "known")
    sizes = known.filter("fold < 4").groupBy("toxic").count().collect()
    if len(sizes) == 2:
        per_class = min(per_class, *(r["count"] for r in sizes))
    lm = [known.filter(f"fold < 4 AND toxic = {c}").orderBy("_o", "_l").limit(per_class) for c in (0, 1)]
    picked = lm[0].unionByName(lm[1]).unionByName(known.filter("fold = 4").orderBy("_o", "_l").limit(calibrate))
    picked = scratch.table(picked.select("_l", "toxic", "fold"), "labels")  # at most 2 * per_class + calibrate narrow rows
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), F.col("_id") == F.col("_l")).select("text", "toxic", "fold")
    sample = scratch.table(sample, "sample")

    pairs = sample.filter("fold < 4").select("text", "toxic").mapInArrow(_pairs, "u long, w long, in0 boolean, in1 boolean")
    pairs = scratch.table(pairs.groupBy("u", "w").agg(F.bool_or("in0").alias("in0"), F.bool_or("in1").alias("in1")), "pairs")
    shared = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counts, "w long, n long")
    shared = scratch.table(shared.groupBy("w").agg(F.sum("n").alias("n")), "shared")
    seen = pairs.agg(F.count_if("in0"), F.count_if("in1")).first()
    rows = sample.filter("fold = 4").select("text", "toxic")
    if min(seen) == 0:
        model = Model(np.empty(0, np.uint64), np.empty(0), 0.0, np.empty(0), np.zeros(2), np.ones(2), float(seen[1] > 0))
        y = rows.agg(F.avg("toxic")).first()[0]
        model.prior = model.prior if y is None else float(y)
        scratch.drop(known, picked, sample, pairs, shared)
        return model
    words, n, back, _ = class_counts(pairs, shared)
    models = [Model(words, *log_ratios(n, back, d), np.empty(0), np.zeros(2), np.ones(2), 0.0) for d in DISCOUNTS]
    held = spark.sparkContext.broadcast(models)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = _texts(batch, "text")
            x = np.column_stack([m.features(texts) for m in held.value])
            yield pa.record_batch({**{f"x{k}": pa.array(x[:, k]) for k in range(x.shape[1])}, "y": batch.column("toxic")})

    names = [f"x{k}" for k in range(2 * len(models))]
    *x, y = _column(rows.mapInArrow(features, ", ".join(f"{c} double" for c in names) + ", y int"), *names, "y")
    scratch.drop(known, picked, sample, pairs, shared)
    best = (np.inf, models[0])
    for m, a, b in zip(models, x[::2], x[1::2]):
        m.prior = float(y.mean()) if len(y) else 0.0
        if len(np.unique(y)) == 2:
            z = np.column_stack([a, b])
            m.weights, m.mean, m.scale = logistic(z, y.astype(float))
            p = np.clip(m.chance(z), 1e-12, 1 - 1e-12)
            loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
            best = min(best, (loss, m), key=lambda t: t[0])
    return best[1]


def _scorer(held, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = [t or b"" for t in batch.column("_row").field(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(held.value.score(texts))], ["_row", "_score"])

    return run


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """_row (all of docs' columns, whatever their names) and _score, one row for each of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return d.mapInArrow(_scorer(held, docs.columns.index(text)), d.select("_row", F.lit(0.0).alias("_score")).schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; null and empty texts have the
    score of no evidence. Learning and nulls: see train(). Repeated rows are scored each."""
    model = train(docs, labels, doc_id=doc_id, text=text, **options)
    s = with_score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return s.select("_row.doc_id", (fold(F.col("_row.doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs, with all their columns, without the rows predicted toxic."""
    return with_score(docs, train(docs, labels, text=text, **options), text).filter("_score < 0.5").select("_row.*")


def query(spark, sf_dir):
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
