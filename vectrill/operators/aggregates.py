"""Vector aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_dimension(df: DataFrame, vector: str, dims: int, how, name: str = "x") -> list:
    """One aggregate a dimension: partial sums combine on the map side, without exploding rows."""
    return [how(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_{name}{i}") for i in range(dims)]


def vector_aggregate(df: DataFrame, vector: str, how: str = "avg", keys: Sequence[str] = (), dims: int | None = None, name: str = "vector") -> DataFrame:
    """avg or sum of the vectors of each group, with the group's count.

    Null vectors are left out. Groups of vectors of different lengths are an error. With dims
    given (or found from the first row), every dimension is one aggregate of one pass.
    """
    df = df.filter(F.col(vector).isNotNull())
    if dims is None:
        first = df.select(F.size(vector)).first()
        dims = first[0] if first else 0
    f = {"avg": F.avg, "sum": F.sum}[how]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("_lo"), F.max(F.size(vector)).alias("_hi"), *by_dimension(df, vector, dims, f))
    v = F.array(*[F.col(f"_x{i}") for i in range(dims)]) if dims else F.array().cast("array<double>")
    same = (F.col("_lo") == dims) & (F.col("_hi") == dims)
    v = F.when(F.col("n") == 0, None).when(same, v).otherwise(F.raise_error(F.lit("vectors of different lengths in one group")))
    return out.select(*keys, "n", v.alias(name))
