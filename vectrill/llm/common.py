"""Shared pieces of the training-data operators: scratch tables, text columns, bounded joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not a word character: ASCII other than 0-9, A-Z, a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_own_roots: dict[str, str] = {}
_live: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, a local session gets one of
    its own; on a cluster it is an error, as other machines couldn't read that folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="vectrill-")
        spark.sparkContext.setCheckpointDir(_own_roots[app])
    return _own_roots[app]


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables in the shared folder; they cut lineage and outlive lost executors.

    An operator drops its intermediate tables itself. What its lazy result still reads stays
    until ``clear_scratch``; lasting tables stay until their owner drops them.
    """

    def __init__(self, spark: SparkSession, name: str, lasting: bool = False):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not lasting:
            _live.append(self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            delete(self.spark, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes every scratch table of this process. Call it when no earlier result is read any more."""
    while _live:
        delete(spark, _live.pop())


def slices(batches: Iterable, rows: int = 1000) -> Iterator:
    """Arrow batches of fewer rows: what is built over all their words stays small. At the end of a
    task the worker, which later tasks use again, gives its free memory back."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in, which agrees there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of ASCII digits, letters and everything beyond ASCII; null and empty give none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", max_broadcast: int = 1_000_000) -> DataFrame:
    """Anti join on a long id. ids is a written table: its counted rows decide between a
    broadcast (at most max_broadcast ids, 16 MB) and a shuffle."""
    few = ids.select(F.col(id_col).alias("_gone")).dropDuplicates()
    if ids.count() <= max_broadcast:
        few = F.broadcast(few)
    return docs.join(few, docs[id_col].eqNullSafe(few["_gone"]), "left_anti")


#: A key with more than 1 / HEAVY of all rows is heavy; there can't be more than HEAVY of them.
HEAVY = 1024


def lookup(rows: DataFrame, table: DataFrame, key: str, heavy: Column | None = None) -> DataFrame:
    """Left join to a table with one row a key. Heavy keys' entries, at most HEAVY of them, are
    broadcast and their rows spread, so no partition holds more than a share of rows. They are
    counted, unless `heavy` tells them by the table's own columns (a size at hand)."""
    extra = [c for c in table.columns if c != key]
    if heavy is None:
        sizes = rows.groupBy(key).count()
        total = F.broadcast(rows.agg(F.count("*").alias("_total")))
        heavy_keys = sizes.join(total).filter(F.col("count") * HEAVY > F.col("_total")).select(F.col(key).alias("_hk"))
        entries = table.join(F.broadcast(heavy_keys), table[key] == F.col("_hk"))
    else:
        entries = table.filter(heavy).withColumn("_hk", F.col(key))
    few = entries.select("_hk", F.struct(*extra).alias("_h"))
    one = rows.join(F.broadcast(few), rows[key] == few["_hk"], "left")
    spread = F.when(F.col("_h").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_003)).cast("int")).otherwise(0)
    own = F.when(F.col("_h").isNull(), F.col(key))
    light = table.select(F.col(key).alias("_lk"), F.lit(0).alias("_ls"), F.struct(*extra).alias("_l"))
    two = one.withColumn("_k", own).withColumn("_s", spread).join(light, (F.col("_k") == F.col("_lk")) & (F.col("_s") == F.col("_ls")), "left")
    return two.select(*rows.columns, F.coalesce("_h", "_l").alias("_v")).select(*rows.columns, *[F.col("_v")[c].alias(c) for c in extra])
