"""Token ids in a content-addressed store.

Rolling hashes cut each document's id stream into chunks. A chunk is stored once, under its
digest; a recipe lists a document's chunks; Merkle roots of the recipes make the manifest.
Reading back verifies every chunk's digest, every document's root and the manifest.

Layout below one folder: ``parts/kind=chunk`` (digest, ids), ``recipes`` (in ascending doc_id
order) and ``manifest`` (a tree of hashes over the documents' roots, up to one root).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.llm.common import Scratch, delete, lookup, slices
from vectrill.llm.encode import BLOCK, encoder, tokenizer_path

#: Ids in a chunk: cuts fall where the rolling hash of the last WINDOW ids has MASK's bits clear.
WINDOW, MASK, LEAST, MOST = 8, 511, 128, 4096
#: Documents of one row of the manifest.
RANGE = 4096
_MIX = np.random.default_rng(11).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)


def rolling(ids: np.ndarray) -> np.ndarray:
    """Where the hash of the WINDOW ids up to a place allows a cut behind it."""
    t = _MIX[ids & 0xFFFF]
    h = t.copy()
    with np.errstate(over="ignore"):
        for k in range(1, WINDOW):
            h[k:] += t[:-k] << np.uint64(k)
    h ^= h >> np.uint64(32)
    return np.flatnonzero((h & np.uint64(MASK)) == 0) + 1


def cuts(n: int, marks: list[int]) -> list[int]:
    """Ends of the chunks of n ids, of LEAST to MOST ids but for the last. marks come from
    rolling(), over this stream or one around it: with LEAST > WINDOW only own ids matter. So
    cuts depend only on nearby ids, and inserted text moves few."""
    out, last = [], 0
    for c in marks:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    return out if last == n else [*out, n]


def digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests, pairs hashed upward; an odd one moves up as it is."""
    while len(leaves) > 1:
        pairs = [digest(b"\x01" + a + b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = pairs + leaves[len(leaves) & ~1 :]
    return leaves[0] if leaves else digest(b"")


PARTS = "kind string, doc_id long, hashes binary, lens binary, n long, root binary, hash binary, ids binary"


def _cutter(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), set()
        end = np.array([end_id], enc.dtype)
        schema = None
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            ids_of = batch.column(0).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and size < BLOCK:
                    size += len(texts[j]) + 1
                    j += 1
                docs, chunks = [], []
                lists = enc.encode(texts[i:j])
                flat = np.concatenate([x for ids in lists for x in (ids, end)])
                stops = np.cumsum([len(x) + 1 for x in lists])
                marks = rolling(flat)
                split = np.searchsorted(marks, stops, "right").tolist()
                raw, w, begin, m0 = flat.tobytes(), flat.itemsize, 0, 0
                marks = marks.tolist()
                for doc, stop, m1 in zip(ids_of[i:j], stops.tolist(), split):
                    ends = cuts(stop - begin, [m - begin for m in marks[m0:m1]])
                    hashes = []
                    for a, b in zip([0, *ends[:-1]], ends):
                        piece = raw[(begin + a) * w : (begin + b) * w]
                        h = digest(piece)
                        hashes.append(h)
                        if h not in seen:  # a task sends each chunk's ids once
                            seen.add(h)
                            chunks.append((h, piece))
                    docs.append((doc, b"".join(hashes), np.diff([0, *ends]).astype("<u4").tobytes(), stop - begin, merkle(hashes)))
                    begin, m0 = stop, m1
                i = j
                if len(seen) > 100_000:
                    seen.clear()
                n, m = len(docs), len(chunks)
                schema = schema or pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("hashes", pa.binary()), ("lens", pa.binary()), ("n", pa.int64()), ("root", pa.binary()), ("hash", pa.binary()), ("ids", pa.binary())])
                none = [None] * m
                cols = [["doc"] * n + ["chunk"] * m, *[[d[k] for d in docs] + none for k in range(5)], [None] * n + [c[0] for c in chunks], [None] * n + [c[1] for c in chunks]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a partition, which holds all of a digest and is sorted by it, passes each chunk on once."""
    last = None
    for batch in batches:
        keep = []
        for h in batch.column("hash").to_pylist():
            keep.append(h is None or h != last)
            last = h
        yield batch.filter(pa.array(keep, pa.bool_()))


def write_store(docs: DataFrame, folder: str, *, end_id: int = 2, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every row of docs and writes the store.

    Null texts count as empty: they have the end id only. Rows with equal or null ids are kept
    apart, nulls first. An empty table makes an empty store. The ids of a chunk leave a task
    once, so a passage that many documents share isn't sent for each of them.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    parts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_cutter(path, end_id), PARTS)
    key = F.coalesce("hash", F.concat("root", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    parts.repartition(key).sortWithinPartitions("hash").mapInArrow(_once, PARTS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/parts")
    scratch = Scratch(spark, "token-ranges")
    recipes = _numbered(spark.read.schema(PARTS).parquet(f"{folder}/parts").filter("kind = 'doc'").select("doc_id", "hashes", "lens", "n", "root"), scratch)
    recipes.repartitionByRange("nth").sortWithinPartitions("nth").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    delete(spark, scratch.root)
    manifest(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _numbered(recipes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds nth (the document's number) and start (ids of all documents before) in doc_id order.

    A prefix scan over range partitions: documents are sorted into partitions once, each
    partition's sums are scanned (one narrow row a partition), then places within a partition.
    Neither sparse ids nor one id that repeats for ever makes a large partition.
    """
    ranged = recipes.repartitionByRange(F.asc_nulls_first("doc_id"), "root").withColumn("part", F.spark_partition_id())
    r = scratch.table(ranged, "ranges")
    sums = r.groupBy("part").agg(F.count("*").alias("docs"), F.sum("n").alias("ids"))
    up = W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    base = sums.select(F.col("part").alias("_part"), (F.sum("docs").over(up) - F.col("docs")).alias("docs_before"), (F.sum("ids").over(up) - F.col("ids")).alias("ids_before"))
    inside = W.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "root").rowsBetween(W.unboundedPreceding, 0)
    rows = r.withColumn("place", F.row_number().over(inside) - 1).withColumn("within", F.sum("n").over(inside) - F.col("n"))
    rows = rows.join(F.broadcast(base), rows["part"] == base["_part"])  # as many rows as partitions
    return rows.select("doc_id", (F.col("docs_before") + F.col("place")).alias("nth"), (F.col("ids_before") + F.col("within")).alias("start"), "n", "hashes", "lens", "root")


def manifest(recipes: DataFrame) -> DataFrame:
    """A Merkle tree over the documents' roots in order, RANGE children a node: level 0 has a row for
    RANGE documents, each level above one for RANGE rows of the one below, up to a single root."""

    def above(rows: DataFrame, level: int) -> DataFrame:
        leaves = F.transform(F.array_sort(F.collect_list(F.struct("nth", "root"))), lambda x: x["root"])
        one = rows.groupBy(F.floor(F.col("nth") / RANGE).alias("range")).agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), F.sha2(F.concat_ws("", leaves).cast("binary"), 256).alias("root"))
        return one.select(F.lit(level).alias("level"), "range", "documents", "ids", "root")

    n = recipes.count()
    rows = above(recipes.select("nth", F.lit(1).cast("long").alias("documents"), F.col("n").alias("ids"), F.hex("root").alias("root")), 0)
    out, level = rows, 0
    while n > RANGE:
        n, level = -(-n // RANGE), level + 1
        rows = above(rows.select(F.col("range").alias("nth"), "documents", "ids", "root"), level)
        out = out.unionByName(rows)
    return out


def _checked(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = batch.column("hash").to_pylist(), batch.column("ids").to_pylist()
            for h, b in zip(hashes, ids):
                if digest(b) != h:
                    raise ValueError(f"chunk {h.hex()} is damaged")
            crc = [zlib.crc32(np.frombuffer(b, f"<u{width}").astype("<u4").tobytes()) for b in ids]
            yield pa.record_batch({"hash": pa.array(hashes, pa.binary()), "crc": pa.array(crc, pa.int64()), "size": pa.array([len(b) // width for b in ids], pa.int64())})

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combines the crc of a document's chunks: crc(a + b) follows from both and b's length."""
    zeros = bytes(4 * MOST)
    plain: dict[int, int] = {}
    for batch in batches:
        out = []
        for chunks, n, root, doc in zip(batch.column("chunks").to_pylist(), batch.column("n").to_pylist(), batch.column("root").to_pylist(), batch.column("doc_id").to_pylist()):
            crc = size = 0
            for c in chunks:
                m = c["size"]
                z = zeros[: 4 * m]
                if m not in plain:
                    plain[m] = zlib.crc32(z)
                crc = zlib.crc32(z, crc) ^ plain[m] ^ c["crc"]
                size += m
            if size != n or merkle([c["hash"] for c in chunks]) != root:
                raise ValueError(f"document {doc} can't be rebuilt from its chunks")
            out.append(crc)
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n"), "ids_crc32": pa.array(out, pa.int64())})


def read_store(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """Reads the store's files back: doc_id, start, n_tokens, ids_crc32 for each document.

    The manifest is computed again from the recipes, every chunk's digest from its bytes, and every
    document's size and Merkle root from its chunks; a difference is an error. Only chunk checksums are joined to the
    recipes, chunks that very many documents share by broadcast.
    """
    if not verify_manifest(spark, folder):
        raise ValueError("the store is damaged: its manifest isn't that of its recipes")
    chunks = spark.read.schema(PARTS).parquet(f"{folder}/parts").filter("kind = 'chunk'").select("hash", "ids").mapInArrow(_checked(width), "hash binary, crc long, size long")
    chunks = Scratch(spark, "token-store").table(chunks, "checksums")
    recipes = spark.read.parquet(f"{folder}/recipes")
    one = recipes.select("doc_id", "nth", "start", "n", "root", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("hashes") / 16).cast("int") - 1), lambda i: F.substring("hashes", i * 16 + 1, F.lit(16)))).alias("at", "hash"))
    found = lookup(one, chunks, "hash")
    docs = found.groupBy("nth").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n").alias("n"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("at", "crc", "size", "hash"))).alias("chunks"))
    return docs.select("doc_id", "start", "n", "root", "chunks").mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def verify_manifest(spark: SparkSession, folder: str) -> bool:
    """Whether the manifest is the one that the recipes give."""
    now, then = manifest(spark.read.parquet(f"{folder}/recipes")), spark.read.parquet(f"{folder}/manifest")
    return now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()


def read_ids(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """doc_id, start and the ids themselves, rebuilt from the chunks."""
    chunks = spark.read.schema(PARTS).parquet(f"{folder}/parts").filter("kind = 'chunk'").select("hash", "ids")
    one = spark.read.parquet(f"{folder}/recipes").select("doc_id", "nth", "start", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("hashes") / 16).cast("int") - 1), lambda i: F.substring("hashes", i * 16 + 1, F.lit(16)))).alias("at", "hash"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(c["ids"] for c in cs), f"<u{width}").astype("<i8").tolist() for cs in b.column("chunks").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "start": b.column("start"), "ids": pa.array(ids, pa.list_(pa.int64()))})

    whole = one.join(chunks, "hash").groupBy("nth").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("chunks"))
    return whole.select("doc_id", "start", "chunks").mapInArrow(unpack, "doc_id long, start long, ids array<long>")


def id_width(tokenizer: str | None = None) -> int:
    return encoder(tokenizer or tokenizer_path()).dtype.itemsize


def encode_and_store(docs: DataFrame, *, end_id: int = 2, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the store and returns what read_store finds in it."""
    folder = folder or Scratch(docs.sparkSession, "token-store").path("store")
    write_store(docs, folder, end_id=end_id, tokenizer=tokenizer, doc_id=doc_id, text=text)
    return read_store(docs.sparkSession, folder, id_width(tokenizer))


def query(spark, sf_dir):
    return encode_and_store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
