"""The pipeline's stages one by one, each on its own input."""

from pathlib import Path

import pytest

import corpus_pipeline as P
from vectrill.llm import decontam, near_dedup, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    before = columns = None
    for i, (name, stage) in enumerate(P.STAGES):
        columns = columns or docs.columns
        ids = sorted(r[0] for r in docs.select("doc_id").collect())
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        got = sorted(r[0] for r in out.select("doc_id").collect())
        if i < 4:
            assert out.columns == columns
        if name == "toxicity":
            want = sorted(r["doc_id"] for r in toxicity.score_toxicity(docs, labels).filter("predicted = 0").collect())
        elif name == "near_dedup":
            want = sorted(r["doc_id"] for r in near_dedup.near_duplicates(docs, k=5).filter("kept").collect())
        elif name == "decontamination":
            want = sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).filter("n_hit = 0").collect())
        elif name == "mixing":
            want, ids = sorted(got), ids
            assert set(got) <= set(ids) and len(set(got)) > 0.9 * len(ids)
        else:
            want = ids
            starts = sorted((r["start"], r["n_tokens"]) for r in out.collect())
            assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
        assert got == want, name
        docs, before = out, got
    assert before


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_store"]


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and empty texts, null ids, rows repeated with one id, an extra column whose name clashes, and no rows."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, _id string"
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0, "x"), (2, "", None, "a", 0, "x"), (3, "one two three four five six seven", "en", None, 3, "x"), (3, "one two three four five six seven", "en", None, 3, "x"), (None, "no id here", "en", "a", 1, "x"), (4, long, "en", "a", None, "x")]
    for n, some in enumerate((rows, [])):
        docs = spark.createDataFrame(some, columns)
        for i, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, SF)
            out.write.parquet(f"{tmp_path}/{n}-{i}")
            out = spark.read.parquet(f"{tmp_path}/{n}-{i}")
            if name != "token_store":
                assert out.columns == docs.columns
            if name in ("toxicity", "near_dedup", "decontamination"):
                assert out.count() == len(some), name
            docs = out
        assert docs.count() <= len(some) + 1 and bool(docs.count()) == bool(some)
