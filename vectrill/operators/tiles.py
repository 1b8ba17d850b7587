"""Pairs of two tables' rows by tiles: a grid of row groups, where each pair of groups meets in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.functions import vector as V

#: Numbers that a row group of a tile holds at most; a table has up to GROUPS groups before they reach it,
#: so what is shuffled grows with the rows until then.
NUMBERS = 1 << 22
GROUPS = 8


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(c.flatten().to_numpy(zero_copy_only=False), float).reshape(len(c), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = np.asarray(b.column("v").value_lengths(), np.int64)
        x = np.asarray(b.column("v").flatten().to_numpy(zero_copy_only=False), float)
        with np.errstate(over="ignore", invalid="ignore"):
            narrow = x.astype(np.float32)
        x = narrow if ((narrow == x) | np.isnan(x)).all() else x
        ends = (np.r_[0, np.cumsum(size)] * x.itemsize).astype(np.int32)
        v = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
        yield pa.record_batch({"id": b.column("id"), "n": pa.array(size.astype(np.int32)), "v": v})


def packed(df: DataFrame, vector: str, id_col: str) -> DataFrame:
    """(id, n, v): rows with a vector, its length and its bytes, four a number where that loses nothing."""
    d = df.select(F.col(id_col).cast("long").alias("id"), V.vec(vector).alias("v")).filter("v IS NOT NULL")
    return d.mapInArrow(_pack, "id long, n int, v binary")


def unpacked(v: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """Packed vectors of length n as rows of doubles."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    if not len(v) or not n:
        return np.zeros((len(v), n))
    wide = np.asarray(pc.binary_length(v)) == 8 * n
    ends = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
    data = v.buffers()[2]
    if not wide.any() or wide.all():
        return np.frombuffer(data, np.float64 if wide.all() else np.float32, len(v) * n, ends[0]).reshape(-1, n).astype(float)
    return np.array([np.frombuffer(data, np.float64 if w else np.float32, n, e) for w, e in zip(wide, ends)], float)


def groups(rows: int, numbers: int, block: int) -> int:
    return max(1, min(GROUPS, rows // block), -(-numbers // NUMBERS))


def meet(left: DataFrame, right: DataFrame, tiles: int, kernel: Callable, schema: str) -> DataFrame:
    """kernel(left, right) of each tile: tables of a tile's rows with all columns but `tile`. left and right have the
    same columns; `tile` is the number of a row's tile, which is one partition: nothing is sorted."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for b in batches:
            side = b.column("side").to_numpy()
            for s in (0, 1):
                if (side == s).any():
                    sides[s].append(b if (side == s).all() else b.filter(pa.array(side == s)))
        if sides[0] and sides[1]:
            yield from kernel(*[pa.Table.from_batches(x).combine_chunks() for x in sides])

    return both.repartitionById(tiles, F.col("tile").cast("int")).drop("tile").mapInArrow(run, schema)


def by_length(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, vectors) of each length among packed rows."""
    size = table.column("n").to_numpy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield int(n), at, unpacked(table.column("v") if len(at) == len(size) else table.column("v").take(pa.array(at)), int(n))


def nearest(k: int, metric: str, digits: int | None = None) -> Callable:
    """A kernel: (q, id, distance) of the k rows on the right nearest to each on the left, of its length."""

    def run(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = {n: (at, x) for n, at, x in by_length(right)}
        for n, at, q in by_length(left):
            if n in rows:
                best = Nearest(q, k, metric, digits)
                best.add(rows[n][1], right.column("id").to_numpy()[rows[n][0]])
                yield from best.found(left.column("id").to_numpy()[at])

    return run


class Nearest:
    """The k nearest rows of each query, by distance, then id; of distances rounded to `digits`, if given.

    Rows are screened by single-precision matrix products with a bound on their error; what passes is
    computed again in double precision from the vectors, so equal rows are equally far.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str = "l2", digits: int | None = None) -> None:
        self.q, self.k, self.metric, self.digits = queries, k, metric, digits
        self.d = np.full((len(queries), k), np.inf)
        self.key = self.d.copy()
        self.i = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.norm = np.sqrt((queries**2).sum(1))
        self.centre = None

    def add(self, x: np.ndarray, ids: np.ndarray, some: np.ndarray | None = None) -> None:
        """More rows; some: the queries that they are for, all of them by default."""
        norm = np.sqrt((x**2).sum(1))
        whole = np.isfinite(norm)
        if not whole.all():
            x, ids, norm = x[whole], ids[whole], norm[whole]
        if not len(x):
            return
        if self.centre is None:
            self.centre = x.mean(0) if self.metric == "l2" else np.zeros(x.shape[1])
        some = np.arange(len(self.q)) if some is None else some
        for s in range(0, len(some), 1024):
            self._screen(some[s : s + 1024], x, ids, norm)

    def _screen(self, at: np.ndarray, x: np.ndarray, ids: np.ndarray, norm: np.ndarray) -> None:
        if self.metric == "cosine":
            q, x2 = (np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0) for v, n in ((self.q[at], self.norm[at]), (x, norm)))
        else:
            q, x2 = self.q[at] - self.centre, x - self.centre
        sq, sx = (q**2).sum(1), (x2**2).sum(1)
        top = max(np.nanmax(sq, initial=0), sx.max())
        kind, unit = (np.float32, 2.0**-24) if 1e-30 < top < 1e30 else (np.float64, 2.0**-53)
        reach = np.sqrt(sx.max())
        blur = 4 * (x.shape[1] + 8) * unit * (2 * np.sqrt(sq) * reach + reach**2)
        a = np.column_stack([q, np.ones(len(q))]).astype(kind) if self.metric == "l2" else q.astype(kind)
        b = (np.column_stack([x2, -sx / 2]) if self.metric == "l2" else x2).astype(kind)
        for c in range(0, len(x), 4096):
            score = a @ b[c : c + 4096].T  # the larger, the nearer
            far = self.key[at, -1] + (10.0**-self.digits if self.digits is not None else 0)
            with np.errstate(over="ignore", invalid="ignore"):
                least = (sq - far**2 - blur) / 2 if self.metric == "l2" else (1 - far if self.metric == "cosine" else -far) - blur
            fresh = np.flatnonzero(np.isinf(far))
            if len(fresh):
                least[fresh] = -np.inf
                if score.shape[1] >= self.k:
                    seed = score[fresh, : max(self.k, 1024)]
                    slack = 10.0**-self.digits if self.digits is not None else 0  # a rounded distance may tie with a longer one
                    kth = np.partition(seed, -self.k, axis=1)[:, -self.k].astype(float)
                    if self.metric == "l2":
                        kth = (sq[fresh] - (np.sqrt(np.maximum(sq[fresh] - 2 * kth, 0) + blur[fresh]) + slack) ** 2) / 2
                    least[fresh] = np.where(np.isfinite(kth), kth - slack - blur[fresh], -np.inf)
            flat = np.flatnonzero(score >= least[:, None].astype(kind))
            for f in range(0, len(flat), 65_536):
                r, j = np.divmod(flat[f : f + 65_536], score.shape[1])
                self._take(at[r], x, ids, norm, j + c)

    def _take(self, r: np.ndarray, x: np.ndarray, ids: np.ndarray, norm: np.ndarray, j: np.ndarray) -> None:
        if self.metric == "l2":
            d = np.sqrt(((self.q[r] - x[j]) ** 2).sum(1))
        else:
            d = -(self.q[r] * x[j]).sum(1)
            if self.metric == "cosine":
                n = self.norm[r] * norm[j]
                d = np.where(n == 0, 1.0, 1 + d / np.where(n == 0, 1, n))
        key, i = d if self.digits is None else np.round(d, self.digits), ids[j]
        worst = self.key[r, -1]
        keep = (key < worst) | ((key == worst) & (i < self.i[r, -1]))
        keep &= d < np.inf
        if not keep.any():
            return
        r, d, key, i = r[keep], d[keep], key[keep], i[keep]
        rows, place = np.unique(r, return_inverse=True)
        g = np.r_[np.repeat(np.arange(len(rows)), self.k), place]
        d, key, i = np.r_[self.d[rows].ravel(), d], np.r_[self.key[rows].ravel(), key], np.r_[self.i[rows].ravel(), i]
        order = np.lexsort((i, key, g))
        g = g[order]
        best = order[np.arange(len(g)) - np.searchsorted(g, np.arange(len(rows)))[g] < self.k]
        self.d[rows], self.key[rows], self.i[rows] = (z[best].reshape(-1, self.k) for z in (d, key, i))

    def found(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(q, id, distance) of what was found, under the queries' ids."""
        for s in range(0, len(ids), 65_536):
            d, i = self.d[s : s + 65_536], self.i[s : s + 65_536]
            hit = d.ravel() < np.inf
            if hit.any():
                yield pa.record_batch({"q": pa.array(np.repeat(ids[s : s + 65_536], self.k)[hit]), "id": pa.array(i.ravel()[hit]), "distance": pa.array(d.ravel()[hit])})
