"""Providers, caches and jobs."""

import pytest

from vectrill import services as S


def test_embed_and_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def provider(texts, model, dims):
        calls.add(len(texts))
        return [[float(len(t))] * dims for t in texts]

    d = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "id int, t string").coalesce(1)
    assert {r[0]: r["embedding"] for r in S.embed(d, "t", provider=provider, dims=2).collect()} == {1: [2.0, 2.0], 2: [2.0, 2.0], 3: [1.0, 1.0], 4: None}
    assert calls.value == 2
    empty = spark.createDataFrame([], "key string, embedding array<double>")
    out, new = S.embed_cached(d, "t", empty, provider=provider, dims=1)
    assert {r["id"]: r["embedding"] for r in out.collect()} == {1: [2.0], 2: [2.0], 3: [1.0], 4: None} and new.count() == 2
    again, none = S.embed_cached(d, "t", new, provider=provider, dims=1)
    assert none.count() == 0 and again.filter("id = 1").first()["embedding"] == [2.0]
    assert S.cross_modal_search(out.filter("t is not null"), "embedding", "zz", 1, provider=provider, dims=1).count() == 1


def test_tasks(spark):
    d = spark.createDataFrame([(1, "One two three. Two three four. Zzz."), (2, None)], "id int, t string")
    assert {r[0]: r["completion"] for r in S.complete(d, "t", params={"max_tokens": 2}).collect()} == {1: "One two", 2: None}
    assert S.summarize(d, "t", sentences=1).first()["summary"] == "One two three."
    z = S.zero_shot(spark.createDataFrame([(1, "cats")], "id int, t string"), "t", ["dogs", "cats"]).first()
    assert z["label"] == "cats" and abs(z["score"] - 1) < 1e-9


def test_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    d = spark.createDataFrame([(1, "hello world"), (2, None)], "id int, t string")
    t = S.tokenize(d, "t", path)
    assert {r["id"]: r["back"] for r in S.detokenize(t, "token_ids", path, name="back").collect()} == {1: "hello world", 2: None}
    assert len(S.tokenize(d, "t", path, max_length=1).first()["token_ids"]) == 1


def test_jobs(spark):
    def provider(prompts, params):
        if "bad" in prompts[0]:
            raise ValueError("no")
        return [prompts[0].upper()]

    j = spark.createDataFrame([(1, "complete", "hi", "a", "queued", 0), (2, "complete", "bad", "a", "queued", 2), (3, "complete", "bad", "a", "queued", 0), (4, "complete", "x", "a", "done", 1)], "job_id int, operation string, input string, tenant_id string, status string, attempts int")
    r = {x["job_id"]: (x["status"], x["attempts"], x["result"], x["error"]) for x in S.run_jobs(j, provider=provider).collect()}
    assert r == {1: ("done", 1, "HI", None), 2: ("failed", 3, None, "no"), 3: ("queued", 1, None, "no"), 4: ("done", 1, None, None)}
