"""Token counts from flat, unindexed token files by a separator scan.

Files are cut into blocks of fixed size. Within a block the separators are found with one
vectorised search. Documents that cross blocks are stitched by a prefix scan over one narrow
summary row a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.llm.common import Scratch, slices
from vectrill.llm.encode import encoder, tokenizer_path

BLOCK_BYTES = 8 << 20


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_flat(docs: DataFrame, folder: str, *, separator: int, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes flat files of little-endian ids, each document followed by the separator.

    Returns, lazily, which document is the nth of which file: (file, nth, doc_id). One task
    writes one file under a fresh name, so a repeated task leaves at most a file that no row
    names. Null texts count as empty. A text that contains the separator id is an error.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        where, base = _filesystem(folder)
        where.create_dir(base, recursive=True)
        name, nth, out = f"{uuid.uuid4().hex}.ids", 0, None
        end = np.array([separator], enc.dtype)
        for batch in slices(batches):
            out = out or where.open_output_stream(f"{base}/{name}")
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for i in range(0, len(texts), 500):
                for ids in enc.encode(texts[i : i + 500]):
                    if (ids == end[0]).any():
                        raise ValueError(f"a text holds the separator id {separator}")
                    out.write(ids.tobytes() + end.tobytes())
            n = batch.num_rows
            yield pa.record_batch({"file": pa.array([name] * n), "nth": pa.array(range(nth, nth + n), pa.int64()), "doc_id": batch.column(0).cast(pa.int64())})
            nth += n
        if out:
            out.close()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "file string, nth long, doc_id long")


def _scan(folder: str, separator: int, width: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(folder)
        for batch in batches:
            for file, size, no in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "block"))):
                with where.open_input_file(f"{base}/{file}") as f:
                    raw = f.read_at(min(block, size - no * block), no * block)
                ids = np.frombuffer(raw, f"<u{width}")
                at = np.flatnonzero(ids == separator)
                head = int(at[0]) if len(at) else len(ids)
                tail = len(ids) - int(at[-1]) - 1 if len(at) else len(ids)
                one = {"file": [file], "block": [no], "n": [len(ids)], "ends": [len(at)], "head": [head], "tail": [tail], "begin": [at[:-1] + 1], "inner": [np.diff(at) - 1]}
                kinds = {"file": pa.string(), "begin": pa.list_(pa.int64()), "inner": pa.list_(pa.int64())}
                yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in one.items()})

    return run


def count_tokens(spark: SparkSession, folder: str, *, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES, names: DataFrame | None = None) -> DataFrame:
    """(file, nth, start, n_tokens) for each document of the flat files: its place among the
    file's documents, its first id's offset, and its ids without the separator.

    names (file): only these are read, so that what a lost task left behind is not. An unclosed last
    document counts if it has ids; empty files have no documents. A file
    whose size isn't a multiple of the width is an error.
    """
    block = block_bytes // width * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))
    if names is not None:
        files = files.join(names.select("file").distinct(), "file", "left_semi")
    files = files.filter("size > 0").withColumn("size", F.when(F.col("size") % width == 0, F.col("size")).otherwise(F.raise_error(F.lit("a token file has a broken size"))))
    blocks = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))).alias("block"))
    found = blocks.repartition("file", "block").mapInArrow(_scan(folder, separator, width, block), "file string, block long, n long, ends long, head long, tail long, begin array<long>, inner array<long>")
    found = Scratch(spark, "token-counts").table(found, "blocks")
    # the prefix scan: nth = documents that ended before a block, open = ids of the one open when it begins
    so_far = W.partitionBy("file").orderBy("block")
    s = found.select("file", "block", "n", "ends", "head", "tail", F.max("block").over(W.partitionBy("file")).alias("last"))
    s = s.withColumn("nth", F.sum("ends").over(so_far) - F.col("ends")).withColumn("run", F.sum(F.signum("ends")).over(so_far))
    s = s.withColumn("after", F.sum("tail").over(W.partitionBy("file", "run").orderBy("block")))
    s = s.withColumn("open", F.coalesce(F.lag("after").over(so_far), F.lit(0).cast("long")))
    at = F.col("block") * (block // width)
    first = s.filter("ends > 0").select("file", "nth", (at - F.col("open")).alias("start"), (F.col("open") + F.col("head")).alias("n_tokens"))
    unclosed = s.filter((F.col("block") == F.col("last")) & (F.col("after") > 0)).select("file", (F.col("nth") + F.col("ends")).alias("nth"), (at + F.col("n") - F.col("after")).alias("start"), F.col("after").alias("n_tokens"))
    place = s.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("nth").alias("_n"))
    rest = found.filter("ends > 1").join(place, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    rest = rest.select("file", "_n", at.alias("_at"), F.posexplode(F.arrays_zip("begin", "inner")).alias("i", "x")).select("file", (F.col("_n") + 1 + F.col("i")).alias("nth"), (F.col("_at") + F.col("x.begin")).alias("start"), F.col("x.inner").alias("n_tokens"))
    return first.unionByName(rest).unionByName(unclosed)


def count_document_tokens(docs: DataFrame, *, separator: int | None = None, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every row of docs to flat files, scans them, and names the documents again:
    (doc_id, n_tokens, file, nth, start). One row for each row of docs, null ids too."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    enc = encoder(path)
    scratch = Scratch(spark, "flat-tokens")
    folder = scratch.path("ids")
    if separator is None:
        separator = enc.tok.get_vocab_size()  # an id that no text can have
        if separator >= 1 << (8 * enc.dtype.itemsize):
            raise ValueError("the tokenizer's ids leave no room for a separator")
    names = scratch.table(write_flat(docs, folder, separator=separator, tokenizer=path, doc_id=doc_id, text=text), "names")
    if names.isEmpty():
        return names.selectExpr("doc_id", "0L AS n_tokens", "file", "nth", "0L AS start")
    counts = count_tokens(spark, folder, separator=separator, width=enc.dtype.itemsize, names=names)
    return names.join(counts, ["file", "nth"]).select("doc_id", "n_tokens", "file", "nth", "start")


def query(spark, sf_dir):
    """File names are random, so the query leaves them out."""
    return count_document_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_tokens")
