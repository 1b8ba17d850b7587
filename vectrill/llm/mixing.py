"""Mixing domains to target weights with soft membership.

A softmax classifier, fitted on the labelled table, gives every document a probability of each
domain. Projected gradient descent on a least-squares problem then finds nonnegative rates,
one a document, such that the expected tokens of each domain match their targets:

    sum_d b_d * (sum_i r_i t_i p_id / (T b_d) - 1) ** 2 + ridge * sum_i t_i / T * (r_i - 1) ** 2,  r >= 0

A step needs from the data only one sum a domain. A document's rate is a function of its own
probabilities and of those sums so far, so rates are recomputed, not stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.llm.common import Scratch, fold, release, slices

#: Hashed byte pairs; labelled rows that train the classifier at most, by smallest hash of their id.
FEATURES, SAMPLE = 1024, 8_000
RIDGE, TOLERANCE, STEPS = 1e-3, 2e-3, 40
#: How a domain's target follows from its share: scarce languages are lifted, poor texts halved.
LIFT, POOR, ROOM = 0.1, 0.5, 1.02
_T = np.random.default_rng(9).integers(0, FEATURES, (2, 256), dtype=np.uint16)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[*range(9, 14), 32]] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the hashed byte pairs' shares with a few layout figures, and words of each text."""
    x, words = np.zeros((len(texts), FEATURES + 4), np.float32), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8)
        if not len(b):
            continue
        if len(b) > 1:
            h = (_T[0][b[:-1]] + _T[1][b[1:]]) & np.uint16(FEATURES - 1)
            x[i, :FEATURES] = np.sqrt(np.bincount(h, minlength=FEATURES) / len(h))
        space = _IS_SPACE[b]
        words[i] = int(np.count_nonzero(~space[1:] & space[:-1])) + int(not space[0])
        lines = t.split(b"\n")
        x[i, FEATURES:] = (np.log1p(len(b)) / 10, len(set(lines)) / len(lines), len(lines) / (1 + words[i]), words[i] / len(b))
    return x, words


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # features by domains
    bias: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, domains: list[str], steps: int = 300, penalty: float = 1e-3) -> Classifier:
    """Softmax regression by Adam on the whole sample."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float32)
    hot = (y[:, None] == np.arange(len(domains))).astype(np.float32)
    w, b = np.zeros((z.shape[1], len(domains)), np.float32), np.zeros(len(domains), np.float32)
    state = [np.zeros_like(a) for a in (w, w, b, b)]
    for k in range(1, steps + 1):
        s = z @ w + b
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - hot) / len(z)
        for a, grad, m, v in ((w, z.T @ g + penalty * w, state[0], state[1]), (b, g.sum(0), state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            a -= 0.02 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Classifier(domains, w, b, mean, scale)


_FITTED = "domains array<string>, weights binary, bias binary, mean binary, scale binary"


def _fit_sample(parts: list[pa.RecordBatch]) -> Classifier:
    table = pa.Table.from_batches(parts)
    place = np.empty(len(table), np.int64)
    place[pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("_id", "domain", "x")]).to_numpy()] = np.arange(len(table))
    names = sorted(set(table.column("domain").to_pylist()))
    x, y, at = np.empty((len(table), FEATURES + 4), np.float32), np.empty(len(table), np.int64), 0
    for p in parts:
        to = place[at : at + p.num_rows]
        x[to] = np.frombuffer(b"".join(p.column("x").to_pylist()), np.float16).reshape(-1, FEATURES + 4)
        y[to] = [names.index(d) for d in p.column("domain").to_pylist()]
        at += p.num_rows
    return fit(x, y, names)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classifier of the whole sample (_id, domain, x), in one task: the driver gets its weights only."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        c = _fit_sample(parts)
        yield pa.record_batch({"domains": pa.array([c.domains], pa.list_(pa.string())), **{k: pa.array([getattr(c, k).astype(np.float32).tobytes()], pa.binary()) for k in ("weights", "bias", "mean", "scale")}})
    del parts
    release()


def train(docs: DataFrame, domains: DataFrame, *, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", sample: int = SAMPLE) -> Classifier:
    """Fits on at most `sample` rows of docs that have a domain. Rows without id or domain are ignored."""
    scratch = Scratch(docs.sparkSession, "mixing")
    named = domains.filter(F.col(domain).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_l")).agg(F.min(F.col(domain).cast("string")).alias("domain"))
    picked = scratch.table(named.orderBy(F.xxhash64("_l"), "_l").limit(sample), "labels")
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), F.col("_id") == F.col("_l")).select("_id", "domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = features([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.record_batch({"_id": batch.column("_id"), "domain": batch.column("domain"), "x": pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())})

    found = rows.select(F.col("_id").cast("long").alias("_id"), "domain", "text").mapInArrow(run, "_id long, domain string, x binary").repartition(1).mapInArrow(_fitted, _FITTED).collect()
    scratch.drop(picked)
    if not found:
        return Classifier(["all"], np.zeros((FEATURES + 4, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    domains, *parts = found[0]
    weights, bias, mean, scale = (np.frombuffer(bytes(v), np.float32) for v in parts)
    return Classifier(domains, weights.reshape(-1, len(domains)), bias, mean, scale)


def memberships(docs: DataFrame, classifier: Classifier, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens (words between ASCII space) and posteriors for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, n = features([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            p = held.value.posteriors(x)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n), "posteriors": pa.array(list(p.astype(float)), pa.list_(pa.float64()))})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, posteriors array<double>")


def rates_of(p: np.ndarray, pulls: list[np.ndarray], step: float, ridge: float) -> np.ndarray:
    """Rates after the steps whose domain residuals are pulls (accelerated, projected to r >= 0)."""
    r = y = np.ones(len(p))
    for k, u in enumerate(pulls):
        new = np.maximum(y - step * (p @ u + ridge * (y - 1)), 0.0)
        y = new + k / (k + 3) * (new - r)
        r = new
    return r, y


def _sums(pulls: list[np.ndarray], step: float, ridge: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            p = np.array(batch.column("posteriors").flatten()).reshape(batch.num_rows, -1)
            t = batch.column("n_tokens").to_numpy()
            both = np.array([(rates_of(p, pulls, step, ridge)[k] * t) @ p for k in (0, 1)])
            total = both if total is None else total + both
        if total is not None:
            yield pa.record_batch({"d": pa.array(range(total.shape[1]), pa.int32()), "r": pa.array(total[0]), "y": pa.array(total[1])})

    return run


def default_targets(domains: list[str], shares: np.ndarray) -> np.ndarray:
    """Target tokens as shares of all present tokens: domains named .../0 are poor and halved, others
    lifted by a small power of their scarcity, so that the largest keeps its tokens."""
    poor = np.array([d.endswith("/0") for d in domains])
    top = shares[~poor].max() if (~poor).any() else 1.0
    lifted = ROOM * shares * (np.maximum(shares, 1e-9) / top) ** -LIFT
    return np.where(poor, POOR * shares, lifted)


def solve(members: DataFrame, targets: np.ndarray, *, ridge: float = RIDGE, tolerance: float = TOLERANCE, steps: int = STEPS) -> tuple[list[np.ndarray], float, np.ndarray]:
    """Residuals a step, the step's length, and the domains' reached token shares. members: a written
    table. Each step is one pass with one sum a domain to the driver."""

    def sums(pulls: list[np.ndarray], step: float) -> np.ndarray:
        rows = members.select("n_tokens", "posteriors").mapInArrow(_sums(pulls, step, ridge, 0), "d int, r double, y double").groupBy("d").agg(F.sum("r").alias("r"), F.sum("y").alias("y")).orderBy("d").collect()
        return np.array([[x["r"] for x in rows], [x["y"] for x in rows]])

    start = sums([], 1.0)
    total = max(start[0].sum(), 1e-12)
    shares = start[0] / total
    b = np.maximum(targets(shares) if callable(targets) else np.asarray(targets, float), 1e-9)
    step = 1 / (float(np.max(shares / b)) + ridge)
    pulls, now = [], start
    for _ in range(steps):
        if np.abs(now[0] / total / b - 1).max() < tolerance:
            break
        pulls.append(now[1] / total / b - 1)
        now = sums(pulls, step)
    return pulls, step, np.array([now[0] / total, b])


def mix(docs: DataFrame, domains: DataFrame, *, targets=None, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", **options) -> tuple[DataFrame, dict]:
    """(table, report). The table has doc_id, n_tokens, domain (likeliest), rate, copies for each
    row of docs; copies is the rate rounded up or down by a hash of the id, so that expected
    tokens match. The report holds each domain's reached and target share.

    targets: {domain: share of present tokens}, default by default_targets; a domain without
    one has 0. domains is the labelled table (doc_id, domain). Null and empty texts have no
    tokens and are rated like others; an empty table gives no rows and no domains' sums.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    classifier = train(docs, domains, doc_id=doc_id, text=text, domain=domain)
    names = classifier.domains
    members = scratch.table(memberships(docs, classifier, doc_id=doc_id, text=text), "members")
    if members.isEmpty():
        return members.selectExpr("doc_id", "n_tokens", "'' AS domain", "0.0D AS rate", "0L AS copies"), {}
    wanted = (lambda s: default_targets(names, s)) if targets is None else np.array([targets.get(d, 0.0) for d in names])
    pulls, step, reached = solve(members, wanted, **options)
    ridge = options.get("ridge", RIDGE)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array(batch.column("posteriors").flatten()).reshape(batch.num_rows, -1)
            best = [names[k] for k in p.argmax(1)] if len(p) else []
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"), "domain": pa.array(best, pa.string()), "rate": pa.array(rates_of(p, pulls, step, ridge)[0] if len(p) else [], pa.float64())})

    table = members.mapInArrow(rate, "doc_id long, n_tokens long, domain string, rate double")
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("mix")), 1) / float(1 << 63)
    report = {d: {"reached": float(r), "target": float(b)} for d, r, b in zip(names, *reached)}
    return table.withColumn("copies", F.floor(F.col("rate") + unit)), report


def resample(docs: DataFrame, domains: DataFrame, **options) -> DataFrame:
    """docs with each row as often as its copies say; rows of zero copies go."""
    doc_id = options.get("doc_id", "doc_id")
    table, _ = mix(docs, domains, **options)
    changed = Scratch(docs.sparkSession, "mixing").table(table.filter("copies != 1").groupBy("doc_id").agg(F.max("copies").alias("_copies")).withColumnRenamed("doc_id", "_mixed"), "copies")
    if changed.count() <= 1_000_000:  # 16 bytes each
        changed = F.broadcast(changed)
    d = docs.join(changed, docs[doc_id].eqNullSafe(changed["_mixed"]), "left")
    times = F.coalesce("_copies", F.lit(1).cast("long"))
    return d.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(times, F.lit(1).cast("long"))))).filter(times > 0).select(*[docs[c] for c in docs.columns])


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the queries: language and quality (1 good, 0 poor) of the labelled
    documents outside fold 0."""
    q = labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").alias("q"))
    return docs.select("doc_id", "lang").filter("lang IS NOT NULL").join(q, "doc_id").select("doc_id", F.concat_ws("/", "lang", F.col("q").cast("string")).alias("domain"))


def query(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(docs, labelled_domains(docs, labels))[0]
