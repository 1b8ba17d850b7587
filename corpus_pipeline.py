"""A corpus pipeline: toxic documents go, near-duplicates are folded, documents with benchmark
passages go, domains are mixed to their target weights, and the rest is stored as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Null and empty texts are neither toxic nor contaminated nor anyone's copies, and are stored as an end
id; repeated rows with one id are one document to near_dedup and rows of their own elsewhere; an empty
table gives an empty table; extra columns of documents come along. A stage deletes what the stage
before it wrote beside its result, which by then is written: stages run one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrill.llm import decontam, mixing, near_dedup, token_store, toxicity
from vectrill.llm.common import Scratch, clear_scratch, delete, without_ids


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted toxic."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates on five words."""
    clear_scratch(spark)  # the stage before is written
    return near_dedup.keep_one(docs, k=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every document in which a verified window of a benchmark item occurs."""
    clear_scratch(spark)
    found = decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"), min_items=1)
    gone = Scratch(spark, "contaminated").table(found.filter("contaminated").select("doc_id"), "ids")
    return without_ids(docs, gone)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the domains' expected tokens meet their targets."""
    clear_scratch(spark)
    return mixing.resample(docs, mixing.labelled_domains(docs, _table(spark, sf_dir, "labels")))


def store_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the documents into the content-addressed store and reads it back."""
    clear_scratch(spark)
    return token_store.encode_and_store(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
    ("token_store", store_token_ids),
]
#: SQL can't express the toxicity models; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each but the last written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark, f"pipeline-{name}", lasting=True)
        docs = scratch.table(stage(spark, docs, sf_dir), "documents")
        if before:
            delete(spark, before.root)
        before = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
