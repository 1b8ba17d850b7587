"""Exact deduplication as a stream over disk-backed keyed state, with DataFrame functions only.

A Structured Streaming aggregation keyed by the SHA-256 digest keeps, without expiry, the
stable identifier and content locator of the row that stays and the group's size. Its state
lives in RocksDB on the executors' disks and in the shared checkpoint folder, so a run can be
continued with new files. Every hit's full bytes are then compared within its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.llm.common import Scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Bits of the broadcast filter that keeps rows without a twin out of the byte check (8 MB at most).
FILTER_BITS = 1 << 26
#: Groups with more than 1 / HEAVY of all rows are joined by broadcast; there can't be more than HEAVY of them.
HEAVY = 1024


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, doc_id: str, text: str, digest) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    place = F.struct(F.regexp_replace("_metadata.file_path", "^([A-Za-z0-9]+):/+", "$1:/").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(F.col(doc_id).alias("_id"), t.alias("_t"), digest(t).alias("_k"), place.alias("_at"))


def update_state(spark: SparkSession, path: str, checkpoint: str, *, doc_id: str = "doc_id", text: str = "text", digest=sha256, bytes_per_batch: int = 1 << 40) -> DataFrame:
    """Streams the files under path that the checkpoint hasn't seen into the keyed state.

    Returns the state: digest, keep_id, locator (file and row of the row that stays), group_size.
    """
    schema = spark.read.parquet(path).schema
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        # the bracket makes a glob, without which a single file is refused as a source
        source = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
        keyed = _rows(source, doc_id, text, digest).groupBy("_k").agg(F.max(F.struct("_id", "_at")).alias("keep"), F.count("*").alias("n"))
        stream = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        return state.select(F.col("key._k").alias("digest"), F.col("value.max._id").alias("keep_id"), F.col("value.max._at").alias("locator"), F.col("value.count").alias("group_size"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _twins(rows: DataFrame, state: DataFrame, bits: int) -> DataFrame:
    """Rows whose digest may have a group of several, by a bitmap of bounded size: no row with a twin is lost."""
    at = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    bitmap = state.filter("group_size > 1").select(at.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bits"))
    at = F.pmod(F.xxhash64("_k"), F.lit(bits)) + 1
    near = rows.withColumn("_b", F.bitmap_bit_position(at)).join(F.broadcast(bitmap), F.bitmap_bucket_number(at) == F.col("_bucket"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_b div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return near.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_b % 8 as int))")) != 0).drop("_b", "_bucket", "_bits")


def dedup(source: str | DataFrame, spark: SparkSession | None = None, *, doc_id: str = "doc_id", text: str = "text", digest=sha256, checkpoint: str | None = None, filter_bits: int = FILTER_BITS, bytes_per_batch: int = 1 << 40) -> DataFrame:
    """One row for each row of the source (Parquet path, or DataFrame, which is written first).

    Returns doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the
    largest doc_id stays; null texts count as empty, null ids as smaller than any other. Of
    rows repeated with the same id and text one is kept, the last by file and row. An empty
    table gives no rows. Extra columns are ignored. Texts are compared byte by byte within
    their digest's group (pre-aggregated before the shuffle, so a huge group moves one text a
    task); a digest shared by different texts is split exactly.
    """
    frame = source if isinstance(source, DataFrame) else None
    spark = frame.sparkSession if frame is not None else spark
    scratch = Scratch(spark, "exact-dedup")
    if frame is not None:
        source = scratch.path("documents")
        frame.select(doc_id, text).write.option("compression", "zstd").parquet(source)
    state = scratch.table(update_state(spark, source, checkpoint or scratch.path("state"), doc_id=doc_id, text=text, digest=digest, bytes_per_batch=bytes_per_batch), "groups")
    rows = _rows(spark.read.parquet(source), doc_id, text, digest)
    total = state.agg(F.sum("group_size")).first()[0] or 0
    seen = _twins(rows, state, filter_bits).groupBy("_k").agg(F.min("_t").alias("a"), F.max("_t").alias("b"))
    clashes = scratch.table(seen.filter("a != b").select(F.col("_k").alias("digest")), "clashes")
    found = _verdicts(rows, state, total)
    if not clashes.isEmpty():
        found = _split(rows, found, clashes)
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_at") == F.col("locator"))
    return found.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def _verdicts(rows: DataFrame, state: DataFrame, total: int) -> DataFrame:
    """Each row with its group. Heavy groups, bounded in number, are broadcast; the other rows are shuffled by digest."""
    heavy = state.filter(F.col("group_size") * HEAVY > total)
    light = state.filter(F.col("group_size") * HEAVY <= total)
    narrow = rows.select("_id", "_at", "_k", F.unhex(F.sha2("_t", 256)).alias("_sha"))
    h = F.broadcast(heavy.select(F.col("digest").alias("_hk"), F.struct("keep_id", "locator", "group_size").alias("_h")))
    one = narrow.join(h, F.col("_k") == F.col("_hk"), "left")
    # rows of heavy groups need no second match: a key of their own spreads them over the partitions
    key = F.when(F.col("_h").isNull(), F.col("_k")).otherwise(F.concat(F.lit("heavy "), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_at.row").cast("string")).cast("binary"))
    two = one.withColumn("_key", key).join(light.select(F.col("digest").alias("_lk"), F.struct("keep_id", "locator", "group_size").alias("_l")), F.col("_key") == F.col("_lk"), "left")
    return two.select("_id", "_at", "_k", "_sha", F.coalesce("_h", "_l").alias("g")).select("_id", "_at", "_k", "_sha", "g.*")


def _split(rows: DataFrame, found: DataFrame, clashes: DataFrame) -> DataFrame:
    """Regroups by full text the rows whose digest several texts share."""
    own = rows.join(clashes, rows["_k"] == clashes["digest"], "left_semi")
    groups = own.groupBy("_k", "_t").agg(F.max(F.struct("_id", "_at")).alias("m"), F.count("*").alias("n"))
    g = groups.select(F.col("_k").alias("_gk"), F.col("_t").alias("_gt"), "m", "n")
    again = own.join(g, (own["_k"] == g["_gk"]) & (own["_t"] == g["_gt"])).select("_id", "_at", "_k", F.unhex(F.sha2("_t", 256)).alias("_sha"), F.col("m._id").alias("keep_id"), F.col("m._at").alias("locator"), F.col("n").alias("group_size"))
    return found.join(clashes, found["_k"] == clashes["digest"], "left_anti").unionByName(again)


def query(spark, sf_dir):
    return dedup(f"{sf_dir}/documents.parquet", spark)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
