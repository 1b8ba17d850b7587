"""MinHash near-deduplication with odd sketches.

Banded MinHash proposes candidates. Folding the MinHash samples into a parity bitmap gives an
odd sketch: the population count of two sketches' XOR estimates their similarity, most
precisely where it is high, and dismisses weak candidates. The others are confirmed word by
word on the full shingle sets. Groups are connected components of confirmed links.

Within a band bucket nobody compares all pairs. Members meet the bucket's centre first, so a
large group of copies costs a link a member. Where a bucket then still holds several
components, two of its members can only be similar if they share a shingle among their rarest
ones (prefix filter: of n shingles in one order for all, n - overlap + 1 are enough). Passages
that many documents share aren't rare, so they make no pairs. No link is lost by this.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrill.llm.common import HEAVY, Scratch, lookup, slices, without_ids
from vectrill.llm.components import components
from vectrill.llm.grams import blocks, hashes, mix, sequence_hashes, sequence_ids, word_ids

#: A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32, 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of the odd sketch, and how often it may dismiss a pair that is just similar enough.
BITS, RISK = 512, 1e-6
#: Pairs of one document that one copy of its text serves; rows of one shingle that one task joins.
FAN = 64
BLOCK = 512
#: Cells of the table of shingle counts that orders them from rare to common (4 MB, whatever the input).
CELLS = 1 << 20
WORDS, NUM, DEN = 4, 80, 100

_rng = np.random.default_rng(1)
_A = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_INSIDE = np.ones(256, bool)
_INSIDE[[*range(9, 14), 32]] = False


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; A-Z lower-cased, words split at ASCII space."""
    out: list[np.ndarray] = []
    for i, j in blocks(texts):
        ids, words, at = word_ids(texts[i:j], _INSIDE)
        w = hashes(words)[ids]
        s = sequence_hashes(w, k)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(s[a : b - k + 1]))
            elif b > a:  # the whole sequence, its length mixed in
                out.append(mix(sequence_hashes(w[a:b], b - a) + np.uint64(b - a)))
            else:
                out.append(s[:0])
    return out


def samples(u: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for i in range(0, len(u), 2048):
            best = np.minimum(best, (u[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return best


def odd_sketches(m: np.ndarray) -> np.ndarray:
    """Parity bitmaps (n, BITS / 64) of MinHash samples (n, SAMPLES)."""
    with np.errstate(over="ignore"):
        bit = (mix(m + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(BITS)).astype(np.int64)
    n = len(m)
    count = np.bincount((np.arange(n)[:, None] * BITS + bit).ravel(), minlength=n * BITS).reshape(n, BITS)
    return np.packbits((count & 1).astype(np.uint8), axis=1).view(np.int64)


def estimate(differ: int) -> float:
    """The similarity for which two odd sketches are expected to differ in so many bits."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * differ / BITS, 1e-9))


def most_bits(similarity: float, risk: float = RISK) -> int:
    """The least bound that the differing bits of a pair of this similarity exceed with at most
    this probability. Of SAMPLES values a binomial number differs, each toggling two bits."""
    p, at = np.zeros(BITS + 1), np.arange(BITS + 1)
    p[0] = 1.0
    out = np.zeros(BITS + 1)
    for d in range(SAMPLES + 1):
        out += math.comb(SAMPLES, d) * (1 - similarity) ** d * similarity ** (SAMPLES - d) * p
        for _ in range(2):
            up, down = p * (BITS - at) / BITS, p * at / BITS
            p = np.concatenate([[0.0], up[:-1]]) + np.concatenate([down[1:], [0.0]])
    over = np.cumsum(out[::-1])[::-1]
    return int(np.flatnonzero(np.append(over[1:], 0.0) <= risk)[0])


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in."""
    with np.errstate(over="ignore"):
        h = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
        for r in range(ROWS):
            h = mix(h + m[:, r::ROWS])
        return h.view(np.int64)


FEATURES = "doc_id long, n long, digest binary, bands array<long>, sketch array<long>"


def _digest(u: np.ndarray) -> bytes | None:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], k)
            full = [x for x, u in enumerate(sets) if len(u)]
            bands: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if full:
                m = np.array([samples(sets[x]) for x in full])
                for x, b, o in zip(full, band_keys(m), odd_sketches(m)):
                    bands[x], sketch[x] = b, o
            yield pa.record_batch({
                "doc_id": batch.column(0).cast(pa.int64()), "n": pa.array([len(u) for u in sets], pa.int64()), "digest": pa.array([_digest(u) for u in sets], pa.binary()),
                "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketch, pa.list_(pa.int64())),
            })

    return run


def _digests(k: int):
    """Texts under the digest of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()], k)
            yield pa.record_batch({"digest": pa.array([_digest(u) for u in sets], pa.binary()), "text": batch.column(0).cast(pa.binary())})

    return run


def similar(left: list[bytes], right: list[bytes], k: int, num: int, den: int) -> list[bool]:
    """For each pair of texts whether its sets of k-word shingles, compared word by word, are similar enough."""
    texts = sorted({*left, *right})
    ids, _, at = word_ids(texts, _INSIDE)
    seq = sequence_ids(ids, k)
    sets = {t: np.unique(seq[a : b - k + 1]) if b - a >= k else None for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist())}
    whole = {t: ids[a:b] for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist()) if b - a < k}
    out = []
    for x, y in zip(left, right):
        p, q = sets[x], sets[y]
        if p is None or q is None:  # fewer than k words: one shingle, which only the same words have
            out.append(p is None and q is None and len(whole[x]) > 0 and np.array_equal(whole[x], whole[y]))
        else:
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(den * both >= num * (len(p) + len(q) - both))
    return out


def _confirm(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            keep: list[bool] = []
            for i, j in blocks([x + y for x, y in zip(left, right)]):
                keep += similar(left[i:j], right[i:j], k, num, den)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cell(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(44)).astype(np.int64)  # the highest 20 bits


def _counts(k: int):
    """How many texts have each cell's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            for u in shingle_sets(batch.column("text").to_pylist(), k):
                np.add.at(total, _cell(u), 1)
        some = np.flatnonzero(total)
        for i in range(0, len(some), 100_000):
            at = some[i : i + 100_000]
            yield pa.record_batch({"cell": pa.array(at), "n": pa.array(total[at])})

    return run


def _rarest(held, k: int, num: int, den: int):
    """The rarest shingles of each text: as many as one that is as long or longer must share one of
    (probe), and of those as many as two of the same length must (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value
        for batch in slices(batches, 500):
            tokens, sizes, place, key = [], [], [], []
            for u in shingle_sets(batch.column("text").to_pylist(), k):
                n = len(u)
                m = n - -(-num * n // den) + 1
                u = u[np.lexsort((u, count[_cell(u)]))][:m]
                tokens.append(u)
                sizes.append(m)
                place.append(np.arange(m))
                key.append(np.arange(m) < n - -(-2 * num * n // (num + den)) + 1)
            if sizes:
                row = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.record_batch({
                    **{c: batch.column(c).take(pa.array(row)) for c in ("uid", "root", "n")}, "token": pa.array(np.concatenate(tokens).view(np.int64)),
                    "place": pa.array(np.concatenate(place), pa.int64()), "key": pa.array(np.concatenate(key), pa.bool_()),
                })

    return run


class _Linker:
    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.docs, self.k, self.num, self.den = docs, k, num, den
        self.most = most_bits(num / den)
        self.scratch = Scratch(docs.sparkSession, "near-dedup")
        table = self.scratch.table
        self.features = table(docs.mapInArrow(_features(k), FEATURES).withColumn("uid", F.monotonically_increasing_id()), "features")
        some = self.features.filter("n > 0")
        key = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "uid")
        # texts with the same set are one class; only its first row goes on
        self.classes = table(some.groupBy("digest").agg(F.min_by(F.struct("doc_id", "uid"), key).alias("r")).select("digest", F.col("r.doc_id").alias("rep_id"), F.col("r.uid").alias("rep")), "classes")
        rep = self.classes.select("rep")
        self.reps = table(some.join(rep, some["uid"] == rep["rep"], "left_semi").select("uid", "n", "bands", "sketch"), "representatives")

    def texts(self, ends: DataFrame) -> DataFrame:
        """(rep, text) of the classes in ends(rep), written."""
        wanted = self.scratch.table(self.classes.join(ends, "rep", "left_semi"), "wanted")
        ids = wanted.select(F.col("rep_id").alias("_want")).distinct()
        if wanted.count() <= 1_000_000:  # 16 bytes each
            ids = F.broadcast(ids)
        found = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["_want"]), "left_semi").select("text").mapInArrow(_digests(self.k), "digest binary, text binary")
        texts = self.scratch.table(found.join(wanted.select("digest", "rep"), "digest").select("rep", "text"), "texts")
        if texts.count() > wanted.count():  # ids that several rows share
            once = self.scratch.table(texts.dropDuplicates(["rep"]), "texts")
            self.scratch.drop(texts)
            texts = once
        self.scratch.drop(wanted)
        return texts

    def with_texts(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """pairs with both texts; a text comes in as many copies as its number of pairs needs."""
        sides = []
        p = pairs
        for end in ("a", "b"):
            many = pairs.groupBy(end).agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts")).filter("parts > 1")
            p = lookup(p, many, end).withColumn(f"part_{end}", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
            t = texts.withColumnRenamed("rep", end).join(many, end, "left")
            sides.append(t.select(end, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias(f"part_{end}"), F.col("text").alias(f"t{end}")))
        return p.join(sides[1], ["b", "part_b"]).join(sides[0], ["a", "part_a"]).select("a", "b", "ta", "tb")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough."""
        texts = self.texts(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
        links = self.scratch.table(self.with_texts(pairs, texts).mapInArrow(_confirm(self.k, self.num, self.den), "a long, b long"), "links")
        self.scratch.drop(texts)
        return links

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) that their sizes and odd sketches allow to be similar enough, written."""
        f = self.reps.select("uid", "n", "sketch")
        one = pairs.join(f.select(F.col("uid").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("s2")), "b")
        two = lookup(one, f.withColumnRenamed("uid", "a"), "a")
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("s2", F.lit(i)))) for i in range(BITS // 64)])
        sizes = F.least("n", "n2") * self.den >= F.greatest("n", "n2") * self.num
        return self.scratch.table(two.filter(sizes & (differ <= self.most)).select("a", "b"), "candidates")

    def members(self) -> DataFrame:
        """(key, uid, center, size) for buckets of several classes."""
        bands = self.reps.select("uid", F.explode("bands").alias("key"))
        sizes = self.scratch.table(bands.groupBy("key").agg(F.min("uid").alias("center"), F.count("*").alias("size")).filter("size > 1"), "sizes")
        found = lookup(bands, sizes, "key", F.col("size") * HEAVY > BANDS * self.reps.count()).filter("size IS NOT NULL")
        found = self.scratch.table(found, "buckets")
        self.scratch.drop(sizes)
        return found

    def across(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs within buckets whose components differ and that share one of their rarest shingles."""
        total = members.count()
        m = members.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        open_ = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("_n")).filter("lo != hi").select("key", "lo", "_n")
        m = lookup(m.filter("uid != center").select("key", "uid", "root"), open_, "key", F.col("_n") * HEAVY > total).filter("lo IS NOT NULL").select("uid", "root").distinct()
        m = self.scratch.table(m.join(self.reps.select("uid", "n"), "uid"), "open")
        texts = self.texts(m.select(F.col("uid").alias("rep")))
        rows = texts.join(m, texts["rep"] == m["uid"]).select("uid", "root", "n", "text")
        counts = rows.select("text").mapInArrow(_counts(self.k), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
        order = np.zeros(CELLS, np.uint32)
        order[counts.column("cell").to_numpy()] = np.minimum(counts.column("n").to_numpy(), (1 << 32) - 1)
        held = self.docs.sparkSession.sparkContext.broadcast(order)
        tokens = self.scratch.table(rows.mapInArrow(_rarest(held, self.k, self.num, self.den), "uid long, root long, n long, token long, place long, key boolean"), "rarest")
        self.scratch.drop(texts)
        out = self.scratch.table(self.sharing(tokens), "sharing")
        self.scratch.drop(tokens, m)
        return out

    def sharing(self, tokens: DataFrame) -> DataFrame:
        """Pairs of different components that share a token: the shorter text has it among its key
        tokens, and what follows in either can still be similar enough. Components are matched first,
        then their members, in blocks, so that those of one component never meet."""
        total = tokens.count()
        shared = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("_n"), F.bool_or("key").alias("any_key"))
        shared = shared.filter("lo != hi AND any_key").select("token", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"), "_n")
        t = lookup(tokens, shared, "token", F.col("_n") * HEAVY > total).filter("blocks IS NOT NULL").drop("_n").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
        t = self.scratch.table(t, "shared")
        q = t.groupBy("token", "root").agg(F.first("blocks").alias("blocks"), F.bool_or("key").alias("any_key"))
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        roots = q.filter("any_key").select("token", F.col("root").alias("r1"), "blocks").join(q.select("token", F.col("root").alias("r2")), "token").filter("r1 != r2").select("token", "r1", "r2", "blocks", each.alias("block"))
        short = t.filter("key").select("token", F.col("root").alias("r1"), "block", F.col("uid").alias("u1"), F.col("n").alias("n1"), F.col("place").alias("p1"))
        long_ = t.select("token", F.col("root").alias("r2"), "block", F.col("uid").alias("u2"), F.col("n").alias("n2"), F.col("place").alias("p2"))
        met = roots.join(short, ["token", "r1", "block"]).select("token", "r2", "u1", "n1", "p1", "blocks").select("token", "r2", "u1", "n1", "p1", each.alias("block"))
        met = met.join(long_, ["token", "r2", "block"])
        longer = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("u1") != F.col("u2")))
        most = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) + F.least("p1", "p2")
        enough = most * (self.num + self.den) >= (F.col("n1") + F.col("n2")) * self.num
        near = met.filter(longer & (F.col("n1") * self.den >= F.col("n2") * self.num) & enough)
        return near.select(F.least("u1", "u2").alias("a"), F.greatest("u1", "u2").alias("b")).distinct()

    def groups(self) -> DataFrame:
        """(rep, root) for classes linked with another."""
        members = self.members()
        star = self.plausible(members.filter("uid != center").select(F.col("center").alias("a"), F.col("uid").alias("b")).distinct())
        links = self.confirmed(star)
        roots = components(links, self.scratch)
        pairs = self.across(members, roots)
        self.scratch.drop(members)
        rest = self.plausible(pairs.join(star, ["a", "b"], "left_anti"))
        more = self.confirmed(rest)
        self.scratch.drop(pairs, star, rest)
        if more.isEmpty():
            return roots
        return components(links.unionByName(more), self.scratch)


def near_duplicates(docs: DataFrame, *, k: int = WORDS, num: int = NUM, den: int = DEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Links join texts whose sets of k-word shingles have den * intersection >= num * union; a
    component's smallest id stays. A text of fewer than k words is one shingle; without words
    (null, empty) it stands alone and stays. Of rows repeated with the same id one stays. Null
    ids never represent a component that has another; extra columns are ignored.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    j = _Linker(d, k, num, den)
    groups = j.groups()
    labelled = j.scratch.table(j.classes.join(groups, j.classes["rep"] == groups["node"], "left").select("digest", "rep_id", "rep", F.coalesce("root", "rep").alias("root")), "labelled")
    key = F.struct(F.coalesce("rep_id", F.lit((1 << 63) - 1)).alias("id"), "rep")
    first = labelled.groupBy("root").agg(F.min_by(F.struct("rep_id", "rep"), key).alias("f"), F.count("*").alias("_n"))
    of = j.scratch.table(lookup(labelled, first, "root", F.col("_n") * HEAVY > labelled.count()).select("digest", F.col("f.rep_id").alias("component_id"), F.col("f.rep").alias("first")), "groups")
    j.scratch.drop(j.classes, j.reps, labelled)
    rows = lookup(j.features.select("doc_id", "uid", "n", "digest"), of, "digest")
    alone = F.col("digest").isNull()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("uid") == F.col("first"))).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without those whose component has an earlier document. Rows repeated with one id count as one document."""
    found = near_duplicates(docs, **options).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept").select("doc_id")
    return without_ids(docs, Scratch(docs.sparkSession, "near-dedup").table(found, "gone"), options.get("doc_id", "doc_id"))


def query(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
