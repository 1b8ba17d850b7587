"""Agglomerative clustering without a matrix of distances: rounds that merge all reciprocal nearest clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: With this many clusters left, their distances fit the driver as a matrix.
FINISH = 3000
#: Rows and columns of a tile of distances.
TALL, WIDE = 256, 2048

_FOLD = {"average": np.add, "single": np.minimum, "complete": np.maximum}


def _spans(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of clusters with at most so many points together, or one cluster."""
    ends, out, i = np.cumsum(sizes), [], 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        out.append((i, j))
        i = j
    return out


def _linked(x: np.ndarray, order: np.ndarray, starts: np.ndarray, wanted: np.ndarray, linkage: str) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(some wanted clusters, the first of a run of clusters, the distances between them); a cluster is infinitely
    far from itself. order: points by cluster; starts: each cluster's first place in it, and the end."""
    fold, sizes = _FOLD[linkage], np.diff(starts)
    columns = _spans(sizes, WIDE)
    for i, j in _spans(sizes[wanted], TALL):
        some = wanted[i:j]
        points = np.concatenate([order[starts[c] : starts[c + 1]] for c in some])
        firsts = np.r_[0, np.cumsum(sizes[some])[:-1]]
        for c0, c1 in columns:
            total = None
            for r in range(0, len(points), TALL):  # more than one only for a single large cluster
                a = x[points[r : r + TALL]].astype(float)
                sa = (a**2).sum(1)
                for c in range(starts[c0], starts[c1], WIDE):
                    b = x[order[c : min(c + WIDE, starts[c1])]].astype(float)
                    d = a @ b.T
                    d *= -2
                    d += sa[:, None]
                    d += (b**2).sum(1)
                    np.maximum(d, 0, out=d)
                    np.sqrt(d, out=d)
                    d = fold.reduceat(d, starts[c0:c1] - c if c1 - c0 > 1 else [0], axis=1)
                    d = fold.reduceat(d, firsts if len(some) > 1 else [0], axis=0)
                    total = d if total is None else fold(total, d)
            if linkage == "average":
                total = total / (sizes[some][:, None] * sizes[c0:c1])
            own = np.flatnonzero((some >= c0) & (some < c1))
            total[own, some[own] - c0] = np.inf
            yield some, c0, total


def _reciprocal(alive: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of clusters that are each other's nearest; the closest pair where rounding leaves none."""
    a = alive[(near[near[alive]] == alive) & (alive < near[alive])]
    if not len(a):
        i = alive[far[alive].argmin()]
        return np.array([min(i, near[i])]), np.array([max(i, near[i])])
    return a, near[a]


class _Tree:
    """Merges and their heights; a cluster's name is its least point."""

    def __init__(self, n: int) -> None:
        self.group, self.height, self.merges = np.arange(n), np.zeros(n), []

    def merge(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        self.height[a] = np.maximum(d, np.maximum(self.height[a], self.height[b]))
        self.merges += zip(self.height[a].tolist(), a.tolist(), b.tolist())
        name = np.arange(len(self.group))
        name[b] = a
        self.group = name[self.group]

    def cut(self, k: int) -> np.ndarray:
        """Each point's cluster when k are left: merges in order of height, a part before the whole."""
        up = list(range(len(self.group)))
        for i in np.argsort([m[0] for m in self.merges], kind="stable")[: max(0, len(up) - max(k, 1))]:
            pair = []
            for p in self.merges[i][1:]:
                while up[p] != p:
                    up[p] = up[up[p]]
                    p = up[p]
                pair.append(p)
            up[max(pair)] = min(pair)
        out = np.array(up)
        while (out[out] != out).any():
            out = out[out]
        return out


def agglomerate(spark: SparkSession, x: np.ndarray, k: int, linkage: str = "average") -> np.ndarray:
    """Each row's cluster, named by its least row, when k clusters are left.

    Merging all pairs of reciprocal nearest clusters gives the same tree as merging the closest pair again
    and again, as these linkages never bring a merged cluster closer to others than its parts were. Only
    clusters that changed or whose nearest changed look for the nearest again: their points against all
    points, a tile at a time, by all tasks. The driver and each worker hold the points and a few numbers
    a point; from FINISH clusters on the driver holds the clusters' distances.
    """
    sc, n = spark.sparkContext, len(x)
    x32 = x.astype(np.float32)
    points = sc.broadcast(x32 if (x32 == x).all() else x)
    tree, near, far = _Tree(n), np.full(n, -1), np.full(n, np.inf)
    tasks = max(1, 3 * sc.defaultParallelism)

    def ask(stale: np.ndarray, finish: bool) -> tuple[np.ndarray, pa.Table]:
        alive = np.unique(tree.group)
        order = np.argsort(tree.group, kind="stable")
        starts = np.r_[np.searchsorted(tree.group[order], alive), n]
        wanted = np.searchsorted(alive, stale)
        load = np.cumsum(np.diff(starts)[wanted])
        share = np.minimum((load - 1) * tasks // load[-1], tasks - 1)
        state = sc.broadcast((order, starts, wanted, share))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, starts, wanted, share = state.value
            for batch in batches:
                for task in batch.column("id").to_pylist():
                    best: dict[int, list] = {}
                    for some, c0, d in _linked(points.value, order, starts, wanted[share == task], linkage):
                        at = d.argmin(1)
                        for i, c in enumerate(some.tolist()):
                            old = best.setdefault(c, [np.inf, -1, []])
                            if d[i, at[i]] < old[0]:
                                old[:2] = d[i, at[i]], c0 + int(at[i])
                            if finish:
                                old[2].append(d[i])
                    names = list(best)
                    for c in range(0, len(names), 500):
                        rows = [best[i] for i in names[c : c + 500]]
                        full = [np.concatenate(r[2]) if finish else None for r in rows]
                        yield pa.record_batch({"c": pa.array(names[c : c + 500], pa.int64()), "near": pa.array([r[1] for r in rows], pa.int64()), "far": pa.array([r[0] for r in rows], pa.float64()), "all": pa.array(full, pa.list_(pa.float64()))})

        got = spark.range(0, tasks, 1, tasks).mapInArrow(run, "c long, near long, far double, all array<double>").toArrow()
        state.destroy()
        return alive, got

    stale = np.arange(n)
    while len(alive := np.unique(tree.group)) > FINISH:
        _, got = ask(stale, False)
        c = alive[got["c"].to_numpy()]
        near[c], far[c] = alive[got["near"].to_numpy()], got["far"].to_numpy()
        a, b = _reciprocal(alive, near, far)
        tree.merge(a, b, far[a])
        alive = np.unique(tree.group)
        changed = np.zeros(n, bool)
        changed[a] = changed[b] = True
        stale = alive[changed[alive] | changed[near[alive]]]
    if len(alive) > 1:
        _, got = ask(alive, True)
        d = np.empty((len(alive), len(alive)))
        for c, row in zip(got["c"].to_pylist(), got["all"]):
            d[c] = row.values.to_numpy()
        _finish(tree, alive, np.bincount(np.searchsorted(alive, tree.group)).astype(float), (d + d.T) / 2, linkage)
    points.destroy()
    return tree.cut(k)


def _finish(tree: _Tree, names: np.ndarray, size: np.ndarray, d: np.ndarray, linkage: str) -> None:
    """The same rounds on a matrix of distances, infinite on its diagonal."""
    alive = stale = np.arange(len(names))
    near, far = np.zeros(len(names), int), np.full(len(names), np.inf)
    while len(alive) > 1:
        near[stale] = d[stale].argmin(1)
        far[stale] = d[stale, near[stale]]
        first, second = _reciprocal(alive, near, far)
        tree.merge(names[first], names[second], far[first])
        for i, j in zip(first.tolist(), second.tolist()):
            a, b = d[i], d[j]
            new = {"single": np.minimum(a, b), "complete": np.maximum(a, b), "average": (size[i] * a + size[j] * b) / (size[i] + size[j])}[linkage]
            new[[i, j]] = np.inf
            d[i] = d[:, i] = new
            d[j] = d[:, j] = np.inf
            size[i] += size[j]
        alive = np.setdiff1d(alive, second)
        changed = np.zeros(len(names), bool)
        changed[first] = changed[second] = True
        stale = alive[changed[alive] | changed[near[alive]]]
