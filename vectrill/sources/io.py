"""Loading tables and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vectrill.functions import vector as V

FORMATS = ("csv", "json", "jsonl", "parquet", "orc", "text")


def load(spark: SparkSession, kind: str, path: str, *, schema: StructType | str | None = None, vector: str | None = None, **options) -> DataFrame:
    """A table from files. CSV has a header by default; JSON without 'l' may span lines. A vector
    column given as text ('[1,2]' or '{1,2}') is parsed. Give a schema for large inputs, so that
    nothing is read to infer one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; one of {', '.join(FORMATS)}")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if kind == "csv":
        options = {"header": True} | ({} if schema is not None else {"inferSchema": True}) | options
    if kind == "json":
        options = {"multiLine": True} | options
    df = r.options(**options).format("json" if kind == "jsonl" else kind).load(path)
    if vector is not None and dict(df.dtypes).get(vector) == "string":
        df = df.withColumn(vector, V.parse(vector))
    return df


def load_jdbc(spark: SparkSession, url: str, table: str, *, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options) -> DataFrame:
    """A table of another database, read in ranges of a numeric key so that no one connection reads all."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()


def save(df: DataFrame, path: str, kind: str = "parquet", *, partition_by: tuple[str, ...] = (), mode: str = "error", **options) -> None:
    """Writes files. CSV gets vectors as text, as it has no arrays."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; one of {', '.join(FORMATS)}")
    if kind == "csv":
        options = {"header": True} | options
        df = df.select(*[V.to_text(c).alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes])
    w = df.write.mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).format("json" if kind == "jsonl" else kind).save(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """A table bucketed and sorted by its join keys: joins on them don't shuffle it."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(table)
