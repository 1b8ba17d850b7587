"""The training-data operators against brute force, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing extra columns."""

import hashlib
import random
import re
import shutil
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrill.llm import components, decontam, exact_dedup, language, license, mixing, near_dedup, pii, token_counts, token_store, toxicity
from vectrill.llm.common import Scratch
from vectrill.llm.encode import Encoder, tokenizer_path

DOC = "doc_id long, text string, lang string, _id long, _uid string, digest string, score string, words string"


def docs(spark, texts, ids=None, langs=None):
    """Documents with extra columns whose names clash with inner and output names."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(i, t, g, 7, "x", "x", "x", "x") for i, t, g in zip(ids, texts, langs)], DOC)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


# ---- decontamination


def test_decontaminate(spark):
    rnd = random.Random(1)
    items = [prose(rnd, 20), prose(rnd, 12), "Short É item", None, "", "..."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [items[0], f"{prose(rnd, 30)} {items[1]} {prose(rnd, 9)} {items[0].upper()}", "a short É item and a Short é item", None, "", "  ", prose(rnd, 3000) + " " + items[1] + " " + items[1], items[0]]
    got = by_id(decontam.decontaminate(docs(spark, texts), bench))
    wins = [[tuple(w[i : i + min(len(w), 8)]) for i in range(max(len(w) - 7, 1))] if w else [] for w in (WORD.findall(low(t)) for t in items)]
    for i, t in enumerate(texts):
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for item, ws in enumerate(wins):
            for g in ws:
                for p in range(len(w) - len(g) + 1):
                    if tuple(w[p : p + len(g)]) == g:
                        found.add(str(item))
                        hit.update(range(p, p + len(g)))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (len(found) >= 2)
        assert sum(s["end"] - s["pos"] for s in r["spans"]) == len(hit)
    blocks = by_id(decontam.decontaminate(docs(spark, texts), bench, max_windows=3))
    assert {i: (r["n_hit"], r["n_items"]) for i, r in blocks.items()} == {i: (r["n_hit"], r["n_items"]) for i, r in got.items()}


def test_decontaminate_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs(spark, ["a b", None], [None, None]), bench).count() == 2
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = decontam.decontaminate(docs(spark, ["a b c"] * 3, [5, 5, None]), one).collect()  # repeated rows stay apart
    assert [r["n_hit"] for r in rows] == [3, 3, 3]


# ---- licenses


def test_licenses(spark):
    texts = [
        "Released under the MIT License. See the Apache license!", "gnu general public license, version 3; CC BY-NC 4.0", "GNU general license", None, "", "mit", "license mit license mit license", "x " * 5000 + "Apache License, Version 2.0",
        "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software", "the É mit\nlicense",
    ]
    got = by_id(license.scan_licenses(docs(spark, texts)))
    for i, t in enumerate(texts):
        w = WORD.findall(low(t))
        places = sorted((p, lab) for ph, lab in license.PHRASES for k in [ph.split()] for p in range(len(w) - len(k) + 1) if w[p : p + len(k)] == k)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert "mit-text" in got[8]["labels"] and "gpl-3.0" in got[1]["labels"] and "cc-by-nc-4.0" in got[1]["labels"]
    assert license.scan_licenses(docs(spark, [])).count() == 0


# ---- exact duplicates


def check_dups(rows, texts, ids):
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(t or "", []).append(i)
    for r in rows:
        g = groups[texts[ids.index(r["doc_id"])] or ""]
        assert r["keep_id"] == max(g) and r["group_size"] == len(g) and r["kept"] == (r["doc_id"] == max(g))
        assert r["text_sha256"] == hashlib.sha256((texts[ids.index(r["doc_id"])] or "").encode()).hexdigest()


def test_exact_dedup(spark):
    texts = ["a", "b", "a", "A", "", None, "a ", "é" * 50_000, "é" * 50_000] + ["hot"] * 60
    check_dups(exact_dedup.dedup(docs(spark, texts)).collect(), texts, list(range(len(texts))))
    weak = lambda t: F.substring(exact_dedup.sha256(t), 1, 0)  # noqa: E731  all texts share a digest
    check_dups(exact_dedup.dedup(docs(spark, texts), digest=weak).collect(), texts, list(range(len(texts))))
    check_dups(exact_dedup.dedup(docs(spark, texts), filter_bits=1 << 15).collect(), texts, list(range(len(texts))))
    assert exact_dedup.dedup(docs(spark, [])).count() == 0
    rows = exact_dedup.dedup(docs(spark, ["a", "a", "a"], [4, 4, None])).collect()
    assert [r["keep_id"] for r in rows] == [4] * 3 and sum(r["kept"] for r in rows) == 1


def test_exact_dedup_continues(spark, tmp_path):
    path, state = f"{tmp_path}/docs", f"{tmp_path}/state"
    docs(spark, ["a", "b"]).write.parquet(path)
    assert exact_dedup.update_state(spark, path, state).count() == 2
    docs(spark, ["b", "c"], [7, 8]).write.mode("append").parquet(path)
    got = {r["keep_id"]: r["group_size"] for r in exact_dedup.update_state(spark, path, state).collect()}
    assert got == {0: 1, 7: 2, 8: 1}


# ---- near duplicates


def brute_near(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sets, [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rnd = random.Random(5)
    texts = [None, "", "one", "ONE", "one two three", "a b c d", "É b c d", "é b c d"]
    for _ in range(12):
        base = prose(rnd, rnd.choice([12, 60, 200, 900]), 5000).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 5, 9, 14, len(w) // 30])):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    shared = prose(rnd, 60, 5000)
    texts += [f"{prose(rnd, 40, 5000)} {shared} {prose(rnd, 40, 5000)}" for _ in range(20)]
    rnd.shuffle(texts)
    sets, root = brute_near(texts)
    got = by_id(near_dedup.near_duplicates(docs(spark, texts)))
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert all(got[i]["kept"] == (root[i] == i) for i in got)
    kept = near_dedup.keep_one(docs(spark, texts))
    assert kept.columns == docs(spark, []).columns and {r["doc_id"] for r in kept.collect()} == set(root)


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    t = "a b c d e f g h"
    rows = near_dedup.near_duplicates(docs(spark, [t, t, t, None], [3, 3, None, None])).collect()
    assert sum(r["kept"] for r in rows if r["n_shingles"]) == 1 and {r["component_id"] for r in rows if r["n_shingles"]} == {3}


def thue_morse(n):
    """Two words of n letters that a polynomial hash modulo 2 ** 64 can't tell apart, from n = 1024 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_near_duplicates_of_words_that_collide(spark):
    one, two = thue_morse(4096)
    got = by_id(near_dedup.near_duplicates(docs(spark, [one, two, f"x y {one} z", f"x y {two} z"])))
    assert [got[i]["component_id"] for i in range(4)] == [0, 1, 2, 3]
    assert near_dedup.similar([one.encode()] * 2, [two.encode(), one.encode()], 4, 80, 100) == [False, True]


def test_near_duplicates_hot_bucket(spark):
    """4,000 texts that share a passage of 60 words, with 8 own words each, and one group of 2,000 near copies
    whose own passage is another: no pairs within the first, a link a member within the second."""
    rnd = random.Random(15)
    passage, base = prose(rnd, 60, 5000), prose(rnd, 90, 5000).split()
    texts = [f"{passage} " + " ".join(f"u{i}x{k}" for k in range(16)) for i in range(4000)]
    for i in range(2000):
        w = list(base)
        w[i % 90] = f"v{i}"
        texts.append(" ".join(w))
    long = prose(rnd, 20_000, 100_000)
    texts += [long, long + " end", prose(rnd, 20_000, 100_000)]
    got = by_id(near_dedup.near_duplicates(docs(spark, texts)))
    assert all(got[i]["component_id"] == i for i in range(4000))
    assert {got[i]["component_id"] for i in range(4000, 6000)} == {4000}
    assert [got[i]["component_id"] for i in (6000, 6001, 6002)] == [6000, 6000, 6002]


def test_pairs_are_compared_word_by_word():
    rnd = random.Random(16)
    texts = [" ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 40))) for _ in range(80)]
    pairs = [(x, y) for x in texts for y in texts if x and y]
    got = near_dedup.similar([x.encode() for x, _ in pairs], [y.encode() for _, y in pairs], 4, 60, 100)
    for (x, y), g in zip(pairs, got):
        (a, b), _ = brute_near([x, y])
        assert g == (100 * len(a & b) >= 60 * len(a | b))


def test_odd_sketch_estimates(spark):
    rng = np.random.default_rng(2)
    for j in (0.8, 0.9, 1.0):
        seen = []
        for _ in range(20):
            u = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            n = int(round(2000 * j / (1 + j)))
            a, b = np.unique(u[:1000]), np.unique(u[1000 - n : 2000 - n])
            s = near_dedup.odd_sketches(np.array([near_dedup.samples(a), near_dedup.samples(b)])).view(np.uint64)
            seen.append(sum(int(x).bit_count() for x in (s[0] ^ s[1])))
            assert seen[-1] <= near_dedup.most_bits(j)
        assert abs(np.mean([near_dedup.estimate(x) for x in seen]) - j) < 0.03
    assert near_dedup.most_bits(0.8) < near_dedup.most_bits(0.7)


def test_components(spark):
    rnd = random.Random(4)
    chain = [(i, i + 1) for i in range(50)] + [(100 + i, 100) for i in range(1, 30)] + [(200 + rnd.randrange(60), 200 + rnd.randrange(60)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in chain:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def test_components_plans_stay_small(spark):
    """The driver plans each round of stars from few readings of the edges, however the rounds go on."""
    seen = []

    class Watched(Scratch):
        def table(self, df, name):
            seen.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
            return super().table(df, name)

    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    got = components.components(links, Watched(spark, "t"))
    assert {(r["node"], r["root"]) for r in got.collect()} == {(i, 0) for i in range(1, 41)}
    assert len(seen) > 4 and max(seen) <= 4


# ---- tokens


def test_encoder_is_exact():
    e = Encoder(tokenizer_path())
    rnd = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "é", "1", "²", ".", ",", "—", "\x1c", "　", "<|endoftext|>", "日本", "́", "_", "don't", "\r\n", "\x85", "٣", "\U0001f600", "×", "ñ", "Ω", "\t"]
    plain = [x for x in parts if x not in ("　", "\x85", "<|endoftext|>")]
    texts = ["".join(rnd.choice(p) for _ in range(rnd.randint(0, 25))) for p in (parts, plain) for _ in range(4000)] + ["", "x" * 100_000, "7" * 5000, " " * 3000]
    for t, ids in zip(texts, e.encode([t.encode() for t in texts])):
        assert ids.tolist() == e.tok.encode(t, add_special_tokens=False).ids


def test_store_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    shared = prose(rnd, 3000)
    texts = ["", None, "hello", shared, shared, f"{prose(rnd, 500)} {shared}", "same", "same"]
    ids = [30, 10, 20, 5, None, 7, 20, 20]
    folder = f"file://{tmp_path}/store"
    rows = token_store.encode_and_store(docs(spark, texts, ids), folder=folder).collect()
    tok = Encoder(tokenizer_path()).tok
    enc = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]
    assert len(rows) == len(texts)
    want, start = {}, 0
    for i in sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0)):
        want.setdefault(ids[i], []).append((len(enc(texts[i])), zlib.crc32(np.array(enc(texts[i]), "<u4").tobytes())))
    for r in rows:
        assert (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
    ends = sorted((r["start"], r["n_tokens"]) for r in rows)
    for s, n in ends:
        assert s == start
        start += n
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == sorted(ids, key=lambda k: (k is not None, k or 0))
    back = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, folder).collect() if r["doc_id"] in (5, 7, 30)}
    assert back == {5: enc(shared), 7: enc(texts[5]), 30: enc("")}
    chunks = spark.read.schema(token_store.PARTS).parquet(f"{folder}/parts").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("hash").distinct().count() < sum(len(r) // 128 + 1 for r in map(enc, texts))
    assert token_store.verify_manifest(spark, folder)


def test_damaged_store_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark, ["hello world"]), folder)
    bad = spark.read.schema(token_store.PARTS).parquet(f"{folder}/parts").withColumn("ids", F.when(F.col("kind") == "chunk", F.unhex(F.lit("0100"))).otherwise(F.col("ids")))
    bad.write.partitionBy("kind").parquet(f"{tmp_path}/bad/parts")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{tmp_path}/bad/{part}")
    with pytest.raises(Exception, match="chunk .* is damaged"):
        token_store.read_store(spark, f"file://{tmp_path}/bad").collect()


def test_changed_recipes_are_refused(spark, tmp_path, monkeypatch):
    """The manifest is a tree: a changed document changes its root, whatever the number of levels."""
    monkeypatch.setattr(token_store, "RANGE", 4)
    folder = f"file://{tmp_path}/store"
    token_store.write_store(docs(spark, [f"text {i}" for i in range(70)]), folder)
    levels = {r["level"]: r["n"] for r in spark.read.parquet(f"{folder}/manifest").groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels == {0: 18, 1: 5, 2: 2, 3: 1} and token_store.verify_manifest(spark, folder)
    top = spark.read.parquet(f"{folder}/manifest").filter("level = 3").first()
    assert top["documents"] == 70
    for part in ("parts", "manifest"):
        shutil.copytree(f"{tmp_path}/store/{part}", f"{tmp_path}/bad/{part}")
    spark.read.parquet(f"{folder}/recipes").withColumn("root", F.when(F.col("nth") == 33, F.unhex(F.lit("00"))).otherwise(F.col("root"))).write.parquet(f"{tmp_path}/bad/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, f"file://{tmp_path}/bad")


def test_empty_store(spark):
    assert token_store.encode_and_store(docs(spark, [])).count() == 0


def test_cuts_move_little():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 20_000).astype("<u2")
    moved = np.concatenate([ids[:5000], rng.integers(0, 50_000, 37).astype("<u2"), ids[5000:]])

    def pieces(x):
        ends = token_store.cuts(len(x), token_store.rolling(x).tolist())
        assert ends[-1] == len(x) and all(b - a <= token_store.MOST for a, b in zip([0, *ends], ends))
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    a, b = pieces(ids), pieces(moved)
    assert len(a - b) <= 3


def test_token_counts(spark, tmp_path):
    texts = ["", None, "hello world", "<|endoftext|> x", "w " * 5000]
    tok = Encoder(tokenizer_path()).tok
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_document_tokens(docs(spark, texts)).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert token_counts.count_document_tokens(docs(spark, [])).count() == 0
    rnd = random.Random(3)
    for trial in range(3):
        folder, want = tmp_path / f"f{trial}", []
        folder.mkdir()
        for f in range(3):
            flat, n = [], rnd.randint(0, 8)
            for k in range(n):
                x = [rnd.randint(0, 8) for _ in range(rnd.choice([0, 1, 2, 5, 40]))]
                want.append((f"{f}.ids", k, len(flat), len(x)))
                flat += [*x, 9]
            if tail := [1] * rnd.choice([0, 3, 20]):
                want.append((f"{f}.ids", n, len(flat), len(tail)))
                flat += tail
            np.array(flat, "<u2").tofile(folder / f"{f}.ids")
        rows = token_counts.count_tokens(spark, str(folder), separator=9, block_bytes=rnd.choice([2, 6, 14])).select("file", "nth", "start", "n_tokens").collect()
        assert sorted(map(tuple, rows)) == sorted(want)
    named = spark.createDataFrame([("0.ids",)], "file string")  # a file that a lost task left has no name
    (tmp_path / "f0" / "left.ids").write_bytes(b"abc")
    assert {r["file"] for r in token_counts.count_tokens(spark, str(tmp_path / "f0"), separator=9, names=named).collect()} <= {"0.ids"}
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.ids").write_bytes(b"abc")
    with pytest.raises(Exception, match="broken size"):
        token_counts.count_tokens(spark, str(tmp_path / "odd"), separator=9).collect()


# ---- personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum((v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out, n = [], {}
    for k, p in PLAIN.items():
        found = []
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m.group(0))
            if {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group(0).split(".")), "card": 13 <= len(d) <= 19 and bool(d) and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                found.append(f"{k}:{m.start()}:{m.end()}")
        n[k] = len(found)
        out += found
    return n, out


def test_pii(spark):
    rnd = random.Random(6)
    parts = ["a", "@", ".", "_", "-", " ", "1", "2", "99", "255", "256", "4111111111111111", "+", "(", ")", "é", "\U0001f600", "b@c.de", "x@y@z.com", "1.2.3.4", "1.2.3.4.5.6.7.8", "+49 30 1234567", "5500 0000 0000 0004", "--", "  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(600)]
    texts += [None, "", "a@b.c_d@e.f", "00000000000001.2.3.4", "9" * 40_000, "a" * 60_000 + "@b.co", "1 " * 20_000, "card 4111-1111-1111-1111, ip 10.0.0.1, mail a.b@c.org tel +1 (212) 555-0100", "é" * 10 + "a@b.co"]
    got = by_id(pii.find_pii(docs(spark, texts)))
    for i, t in enumerate(texts):
        n, spans = brute_pii(t)
        r = got[i]
        assert {k: r[f"n_{k}"] for k in n} == n, t
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(filter(None, r["spans"].split(",")))
        order = [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["found"]]
        assert order == sorted(set(order))


def card(rnd, right=True):
    d = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
    return d + next(str(c) for c in range(10) if luhn(d + str(c)) == right)


def test_pii_trees_add_spans(spark):
    """What a rule loses in a longer run or for a letter, and trees that know such spans give back; decoys stay out."""
    rnd = random.Random(8)
    texts = []
    for i in range(600):
        kind = [card(rnd), card(rnd, False), f"user{i}@{'post.' * (i % 5)}host{i % 7}.example.com", f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}", f"10.0.{i % 250}.7", f"{rnd.randrange(10**7)}-{rnd.randrange(10**6)}"][i % 6]
        left, right = (prose(rnd, n).translate(str.maketrans("0123456789", "abcdefghij")) for n in (6, 4))  # a digit before a card would join it
        texts.append(f"{left} {kind} {right}")
    one, two, decoy = card(rnd), card(rnd), card(rnd, False)
    more = [f"pay {one} {two} now", f"pay {one} {decoy} now", "call +1 (826) 555-4081 190.137.223.204 today", "mail jósé5 (at) correo.example.com now", f"number {decoy} only", f"dots {one[:4]}.{one[4:8]}.{one[8:12]}.{one[12:]} end"]
    got = by_id(pii.find_pii(docs(spark, texts + more)))
    found = [{t[s["start"] : s["end"]] for s in got[600 + i]["found"]} for i, t in enumerate(more)]
    assert {one, two} <= found[0] and one in found[1] and decoy not in found[1]
    assert "+1 (826) 555-4081" in found[2] and "jósé5 (at) correo.example.com" in found[3]
    assert not found[4] and f"{one[:4]}.{one[4:8]}.{one[8:12]}.{one[12:]}" in found[5]
    assert not any(brute_pii(t)[1] for t in (more[0], more[1], more[3], more[5]))  # no rule finds these
    added = [t[s["start"] : s["end"]] for i, t in enumerate(texts) for s in got[i]["found"] if f"{s['kind']}:{s['start']}:{s['end']}" not in brute_pii(t)[1]]
    assert len(added) <= 6 and not any(luhn(re.sub('[^0-9]', '', x)) is False and x.isdigit() for x in added), added


def test_pii_of_long_texts(spark):
    """Patterns neither recurse nor search again, and many spans of one text cost no more each."""
    texts = ["a@b" + ".c" * 1000, "a@b" + ".c" * 1_000_000, "a(at)b" + " (dot) c" * 100_000, "7" * 200_000, "1 " * 200_000, " ".join(f"u{i}@ex.org" for i in range(50_000)), "1.2.3.4 " * 20_000]
    began = time.time()
    got = by_id(pii.find_pii(docs(spark, texts)))
    assert time.time() - began < 120
    assert [got[i]["n_email"] for i in range(7)] == [1, 1, 0, 0, 0, 50_000, 0] and got[6]["n_ip"] == 20_000
    for i in (0, 1, 5, 6):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(brute_pii(texts[i])[1]).encode()).hexdigest()


def test_pii_edges(spark):
    assert pii.find_pii(docs(spark, [])).count() == 0
    assert [r["spans"] for r in pii.find_pii(docs(spark, ["nothing", None], [None, None])).collect()] == ["", ""]


# ---- learning operators


def test_language(spark):
    rnd = random.Random(7)
    words = {"aa": ["kala", "maka", "luna"], "bb": ["sterk", "wijn", "brood"], "cc": ["ération", "ènes", "çaux"]}
    texts, langs = [], []
    for i in range(300):
        g = list(words)[i % 3]
        texts.append(" ".join(rnd.choice(words[g]) for _ in range(rnd.randint(3, 60))))
        langs.append(g if i % 5 else None)
    texts += [None, "", "123 !?", "kala maka luna " * 4000]
    langs += [None, "aa", "bb", None]
    got = by_id(language.identify(docs(spark, texts, langs=langs)))
    assert all(got[i]["lang_pred"] == list(words)[i % 3] for i in range(300)) and got[303]["lang_pred"] == "aa"
    assert [got[i]["lang_pred"] for i in (300, 301, 302)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert language.identify(docs(spark, [])).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs(spark, ["abc"])).collect()} == {"und"}


def test_language_ignores_held_out_and_label(spark):
    """Changing the language of held-out rows changes no prediction."""
    texts = [("kala maka " if i % 2 else "sterk wijn ") * (1 + i % 9) for i in range(120)]
    a = ["aa" if i % 2 else "bb" for i in range(120)]
    b = ["zz" if zlib.crc32(str(i).encode()) % 5 == 0 else x for i, x in enumerate(a)]
    p, q = (by_id(language.identify(docs(spark, texts, langs=g))) for g in (a, b))
    assert {i: (r["lang_pred"], r["score"]) for i, r in p.items()} == {i: (r["lang_pred"], r["score"]) for i, r in q.items()}


def labelled(rnd, n):
    texts, toxic = [], []
    for i in range(n):
        w = prose(rnd, rnd.randint(20, 80), 800).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vile", "foul", "nasty"]))
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


def test_toxicity(spark):
    texts, toxic = labelled(random.Random(9), 800)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    d = docs(spark, [*texts, None, "", "vile foul nasty vile"])
    got = by_id(toxicity.score_toxicity(d, labels))
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(800))
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.97
    assert got[802]["predicted"] == 1 and got[800]["score"] == got[801]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = by_id(toxicity.score_toxicity(d, other))
    assert {i: round(r["score"], 9) for i, r in again.items()} == {i: round(r["score"], 9) for i, r in got.items()}


def test_toxicity_models_are_kneser_ney(spark):
    """Every word's ratio against plain dictionaries, rare words and copies included."""
    rnd = random.Random(19)
    texts = [prose(rnd, rnd.randint(1, 60), 90) + (" foul" if i % 3 == 0 else "") for i in range(240)]
    texts += [texts[0]] * 9 + [None, "", "Solo", "É é"]
    fold = [zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))]
    learn = [i for i in range(240) if 0 < fold[i] < 4]
    half = len(learn) // 2
    toxic = {i: int(k < half) for k, i in enumerate(learn[: 2 * half])}
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts), labels)
    before = [{}, {}]
    for i, y in toxic.items():
        for u, w in zip([None, *WORD.findall(low(texts[i]))], WORD.findall(low(texts[i]))):
            before[y].setdefault(w, set()).add(u)
    left_over = lambda y, d: sum(min(len(x), d) for x in before[y].values()) / sum(map(len, before[y].values()))
    places = {}
    for t in texts:
        for w in WORD.findall(low(t)):
            places[w] = places.get(w, 0) + 1
    all_places = sum(places.values())
    d = next(x for x in toxicity.DISCOUNTS if np.isclose(model.other, np.log(left_over(1, x) / left_over(0, x))))  # the one that calibration chose

    def prob(y, w):
        n = sum(map(len, before[y].values()))
        return max(len(before[y].get(w, ())) - d, 0) / n + left_over(y, d) * (places.get(w, 0) + 1) / (all_places + len(places) + 1)

    got, bounds = model.ratios([(t or "").encode() for t in [*texts, "never seen"]])
    words = [WORD.findall(low(t)) for t in [*texts, "never seen"]]
    assert bounds.tolist() == np.cumsum([0] + [len(w) for w in words]).tolist()
    assert np.allclose(got, [np.log(prob(1, w) / prob(0, w)) for ws in words for w in ws])
    x = model.features([(t or "").encode() for t in texts])
    for t, row in zip(texts, x):
        r = [float(np.log(prob(1, w) / prob(0, w))) for w in WORD.findall(low(t))]
        k = min(len(r), toxicity.PASSAGE)
        best = max((np.mean(r[i : i + k]) for i in range(len(r) - k + 1)), default=0.0) if r else 0.0
        assert np.allclose(row, [np.mean(r) if r else 0.0, best])


def test_toxicity_of_long_and_repeated_texts(spark):
    texts, toxic = labelled(random.Random(9), 400)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    rnd = random.Random(20)
    more = [prose(rnd, 200_000, 800), prose(rnd, 100_000, 800) + " vile foul nasty " + prose(rnd, 100_000, 800), "vile foul nasty", "vile foul nasty"]
    rows = toxicity.score_toxicity(docs(spark, texts + more, [*range(400), 1000, 1001, 1002, 1002]), labels).filter("doc_id >= 1000").collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in rows) == [(1000, 0), (1001, 1), (1002, 1), (1002, 1)]


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs(spark, []), none).count() == 0
    assert [r["score"] for r in toxicity.score_toxicity(docs(spark, ["a", None]), none).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(docs(spark, ["a b"] * 50), ones).collect()} == {1.0}


def test_mixing(spark):
    rnd = random.Random(10)
    texts, names = [], []
    for i in range(400):
        k = "x" if i % 4 else "y"
        texts.append(" ".join(rnd.choice(["kala", "maka"] if k == "x" else ["sterk", "brood"]) for _ in range(rnd.randint(5, 40))))
        names.append(k)
    dom = spark.createDataFrame([(i, n) for i, n in enumerate(names) if i % 3], "doc_id long, domain string")
    d = docs(spark, [*texts, None, ""])
    table, report = mixing.mix(d, dom, targets={"x": 0.5, "y": 0.5})
    rows = by_id(table)
    assert len(rows) == 402 and all(r["rate"] >= 0 for r in rows.values())
    for r in report.values():
        assert abs(r["reached"] / r["target"] - 1) < 0.01
    total = sum(r["n_tokens"] for r in rows.values())
    real = sum(r["n_tokens"] * r["rate"] for i, r in rows.items() if i < 400 and names[i] == "y")
    assert abs(real / total - 0.5) < 0.03
    out = mixing.resample(d, dom, targets={"x": 0.5, "y": 0.5})
    assert out.columns == d.columns and out.count() == sum(r["copies"] for r in rows.values())
    assert mixing.mix(docs(spark, []), dom)[0].count() == 0
    assert mixing.mix(d, dom.limit(0))[0].count() == 402


def test_mixing_sample_stays_off_the_driver(spark, monkeypatch):
    """The classifier is fitted in a task, on all rows of the sample in the order of their ids; rows repeated with one id count each."""
    texts = [" ".join(["kala maka", "sterk brood"][i % 2] for _ in range(3 + i % 5)) for i in range(60)]
    ids = [(7 * i) % 59 for i in range(60)]
    dom = spark.createDataFrame([(i, "xy"[i % 3 == 0]) for i in range(59)], "doc_id long, domain string")
    rows = [(i, "xy"[i % 3 == 0], mixing.features([t.encode()])[0][0].astype(np.float16)) for i, t in zip(ids, texts)]
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    want = mixing.fit(np.array([r[2] for r in rows], np.float32), np.array(["xy".index(r[1]) for r in rows]), ["x", "y"])

    def refuse(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(mixing, "fit", refuse)
    got = mixing.train(docs(spark, texts, ids), dom)
    assert got.domains == want.domains and len(rows) == 60
    for k in ("weights", "bias", "mean", "scale"):
        assert getattr(got, k).shape == getattr(want, k).shape and np.allclose(getattr(got, k), getattr(want, k), atol=1e-4)


def test_rates_solve_the_problem():
    """The steps reach what a direct solution of the same least squares gives."""
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    t = rng.integers(1, 50, 200).astype(float)
    b = np.array([0.5, 0.3, 0.2])
    pulls, y = [], np.ones(200)
    step = 1 / (float(((t @ p) / t.sum() / b).max()) + 1e-3)
    for _ in range(60):
        pulls.append((y * t) @ p / t.sum() / b - 1)
        r, y = mixing.rates_of(p, pulls, step, 1e-3)
    assert np.abs((r * t) @ p / t.sum() / b - 1).max() < 0.01 and r.min() >= 0
