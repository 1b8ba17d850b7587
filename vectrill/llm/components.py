"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrill.llm.common import HEAVY, Scratch, lookup


def _star(edges: DataFrame, total: int) -> DataFrame:
    """Each edge with the least of u's neighbours and u; the edges of a u with very many are spread."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    return lookup(edges, least, "u", F.col("_n") * HEAVY > total).drop("_n")


def _pairs(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Edges (u, v), one for each two columns named and each row, from one reading of the rows."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])))


def components(links: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """links(a, b) of longs -> (node, root): root is the smallest node reachable.

    Each round writes the edges to the shared folder, so lineage stays short: twice, as a plan of
    both stars would read the edges 36 times and fill the driver. The loop ends when a round
    changes nothing, after about log2 of the longest chain rounds.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = scratch.table(e, "edges")
    last, total = None, e.count()
    for _ in range(most):
        large = _star(_pairs(e, ("u", "v"), ("v", "u")), 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = scratch.table(large, "large")
        small = _pairs(_star(large, total), ("u", "m"), ("v", "m")).filter("u != v").distinct()
        new = scratch.table(small, "edges")
        scratch.drop(e, large)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, total = now, now[0]
    raise RuntimeError(f"components did not settle in {most} rounds")
