"""Traversal and ranking of graphs given as edges (src, dst)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.functions import vector as V
from vectrill.operators.lineage import cut


def _adjacent(edges: DataFrame, unique: bool = False) -> DataFrame:
    """(src, dsts): edges written once, a row a source, placed by source over the session's shuffle partitions,
    so that rounds can join what is placed by node without moving the edges again."""
    e = edges.select("src", "dst").repartition(_parts(edges), "src").groupBy("src")
    return cut(e.agg((F.collect_set if unique else F.collect_list)("dst").alias("dsts")))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bfs(edges: DataFrame, start: int, max_depth: int = -1) -> DataFrame:
    """(node, depth, parent) of nodes reachable from start along src -> dst. The parent is the smallest
    of the previous layer. Edges are read once; each layer is one join of the frontier; seen nodes are left out."""
    spark = edges.sparkSession
    e = _adjacent(edges)
    front = spark.createDataFrame([(int(start), 0, None)], "node long, depth int, parent long")
    seen = cut(front)
    front, depth = seen, 0
    while max_depth < 0 or depth < max_depth:
        depth += 1
        step = e.join(front.select(F.col("node").alias("src")), "src").select("src", F.explode("dsts").alias("node")).groupBy("node").agg(F.min("src").alias("parent"))
        front = cut(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if depth % 5 == 0 else seen.unionByName(front)
    return seen


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, score): power iteration from a uniform start. The mass of nodes without out-edges is
    dropped. Stops when no score changes by the tolerance. The adjacency is written once, keyed
    by source; a round shuffles one row an edge at most, combined on the map side."""
    e = _adjacent(edges)
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select(F.explode("dsts"))).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    rank = nodes.withColumn("score", F.lit(1.0 / n))
    for i in range(iterations):
        given = e.join(rank.withColumnRenamed("node", "src"), "src").select((F.col("score") / F.size("dsts")).alias("share"), F.explode("dsts").alias("node"))
        got = given.groupBy("node").agg(F.sum("share").alias("in"))
        new = nodes.join(got, "node", "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("in", F.lit(0.0))).alias("score"))
        new = cut(new)
        if tolerance > 0:
            change = new.alias("a").join(rank.alias("b"), "node").agg(F.max(F.abs(F.col("a.score") - F.col("b.score")))).first()[0]
            if change < tolerance:
                return new
        rank = new
    return rank


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by label propagation: each round a node takes the most frequent label of
    itself and its neighbours, the smallest on ties. Labels are the smallest node ids that spread.
    Nodes tell neighbours their labels, which go to the neighbour's place once and are counted there."""
    once = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src != dst")
    # a node votes for its own label, too; otherwise two neighbours would swap labels for ever
    ways = F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in ("sd", "ds")]))
    both = once.distinct().select(F.col("src").alias("s"), F.col("dst").alias("d")).select(ways.alias("e")).select("e.src", "e.dst")
    e = _adjacent(both)
    label = e.select(F.col("src").alias("node"), F.col("src").alias("community"))
    for _ in range(rounds):
        told = e.join(label.withColumnRenamed("node", "src"), "src").select(F.explode(F.array_append("dsts", F.col("src"))).alias("node"), "community")
        votes = told.repartition(_parts(edges), "node").groupBy("node", "community").agg(F.count("*").alias("n"))
        new = cut(votes.groupBy("node").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")))
        moved = new.alias("a").join(label.alias("b"), "node").filter("a.community != b.community").isEmpty()
        label = new
        if moved:
            break
    return label


def modularity(edges: DataFrame, label: DataFrame) -> float:
    """Of an undirected graph's communities."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src != dst").distinct()
    a, b = label.select(F.col("node").alias("src"), F.col("community").alias("a")), label.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    x = both.join(a, "src").join(b, "dst")
    m = x.count()
    if not m:
        return 0.0
    inner = x.filter("a = b").count() / m
    return inner - (x.groupBy("a").count().agg(F.sum((F.col("count") / m) ** 2)).first()[0] or 0.0)


#: Neighbours that a row of a depth-first search's input holds at most.
RUN = 1 << 20


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, n, low, high, dsts): sorted edges, each once, as one row a source and batch, its neighbours' numbers as bytes."""
    last = None
    for b in batches:
        for c in range(0, b.num_rows, RUN):
            src, dst = (b.column(x).slice(c, RUN).to_numpy() for x in ("src", "dst"))
            new = np.r_[last != (src[0], dst[0]), (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
            last, src, dst = (src[-1], dst[-1]), src[new], dst[new]
            if not len(src):
                continue
            at = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
            cuts = np.r_[at, len(src)].astype(np.int32)
            dsts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((8 * cuts).tobytes()), pa.py_buffer(dst.tobytes())])
            yield pa.record_batch({"src": pa.array(src[at]), "n": pa.array(np.diff(cuts).astype(np.int64)), "low": pa.array(dst[at]), "high": pa.array(dst[cuts[1:] - 1]), "dsts": dsts})


def _walk(start: int, edges: int, low: int, high: int):
    """Depth-first over runs of neighbours. An edge takes four bytes where node numbers allow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.empty(edges, np.int32 if -(2**31) <= low and high < 2**31 else np.int64)
        whose, many, n = [], [], 0
        for b in batches:
            column = b.column("dsts")
            if not b.num_rows:
                continue
            cuts = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + b.num_rows + 1].astype(np.int64)
            got = np.frombuffer(column.buffers()[2], np.int64, (cuts[-1] - cuts[0]) // 8, cuts[0])
            near[n : n + len(got)] = got
            n += len(got)
            whose.append(b.column("src").to_numpy().copy())
            many.append(np.diff(cuts) // 8)
        whose, many = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (whose, many))
        near = near[:n]
        names = None  # numbers with few gaps are places by themselves
        if low < 0 or high > 8 * (len(whose) + 1024):
            names = np.unique(np.concatenate([np.unique(near).astype(np.int64), whose, [start]]))
            for c in range(0, n, RUN):
                near[c : c + RUN] = np.searchsorted(names, near[c : c + RUN])
            whose = np.searchsorted(names, whose)
        size = high + 1 if names is None else len(names)
        # a source that was cut into several runs has them side by side
        first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(whose) else np.empty(0, np.int64)
        begins = np.r_[0, np.cumsum(many)]
        at, stop = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at[whose[first]], stop[whose[first]] = begins[first], begins[np.r_[first[1:], len(whose)].astype(np.int64)] if len(first) else 0
        root = start if names is None else int(np.searchsorted(names, start))
        seen, came, found, left = np.zeros(size, bool), np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        at_, stop_, came_, found_, left_, seen_, near_ = (memoryview(x) for x in (at, stop, came, found, left, seen, near))
        seen[root], found_[root], clock, node = True, 1, 1, root
        while True:
            p, end, nxt, step = at_[node], stop_[node], -1, 8
            for q in range(p, min(p + 4, end)):  # mostly one of the next few is new; single reads are quicker then
                p = q + 1
                if not seen_[near_[q]]:
                    nxt = near_[q]
                    break
            while nxt < 0 and p < end:
                some = near[p : min(p + step, end)]
                new = ~seen[some]
                k = int(new.argmax())
                if new[k]:
                    nxt, p = int(some[k]), p + k + 1
                    break
                p, step = p + len(some), min(4 * step, 8192)
            at_[node] = p
            clock += 1
            if nxt < 0:
                left_[node] = clock
                if node == root:
                    break
                node = came_[node]
            else:
                seen[nxt], came_[nxt], found_[nxt], node = True, node, clock, nxt
        reached = np.flatnonzero(seen)
        for c in range(0, len(reached), 1 << 18):
            i = reached[c : c + (1 << 18)]
            up = came[i]
            name, parent = (i, up) if names is None else (names[i], names[up])
            yield pa.record_batch({"node": pa.array(name, pa.int64()), "discovery": pa.array(found[i]), "finish": pa.array(left[i]), "parent": pa.array(parent, pa.int64(), mask=up < 0)})

    return run


def dfs(edges: DataFrame, start: int, max_edges: int | None = None) -> DataFrame:
    """(node, discovery, finish, parent) in depth-first order, smaller neighbours first. The order is serial
    by nature. All tasks sort the edges; one task walks their numbers, in four bytes
    an edge and some thirty a node, without copies. More edges than max_edges, if given, are an error."""
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).dropna()
    runs = cut(e.repartition("src").sortWithinPartitions("src", "dst").mapInArrow(_runs, "src long, n long, low long, high long, dsts binary"))
    n, low, high = runs.agg(F.sum("n"), F.least(F.min("src"), F.min("low")), F.greatest(F.max("src"), F.max("high"))).first()
    if max_edges is not None and (n or 0) > max_edges:
        raise ValueError(f"depth-first search walks at most {max_edges} edges in one task")
    walk = _walk(int(start), n or 0, min(low or 0, int(start)), max(high or 0, int(start)))
    return runs.select("src", "dsts").coalesce(1).mapInArrow(walk, "node long, discovery int, finish int, parent long")


def graph_knn(edges: DataFrame, vectors: DataFrame, start: int, query: Sequence[float], k: int = 10, max_hops: int = 3, *, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(node, distance, hops) of the nearest vectors within max_hops of a node."""
    near = bfs(edges, start, max_hops).select("node", F.col("depth").alias("hops"))
    v = vectors.select(F.col(id_col).alias("node"), V.l2_distance(vector, query).alias("distance"))
    return near.join(v, "node").select("node", "distance", "hops").orderBy("distance", "node").limit(k)
