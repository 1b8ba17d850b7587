"""Steps of the training-data operators' methods that neither SQL nor the other tests see."""

from vectrill.llm import license

DOC = "doc_id long, text string"


def test_license_spans_are_verified(spark):
    want = {
        "GNU General Public License, version 3": "gpl,gpl-3.0",
        "the GNU General Public License version 2 or later": "gpl,gpl-2.0",
        "GNU General Public License (GPL) version 3": "gpl,gpl-3.0",
        "GNU Lesser General Public License, version 3": "lgpl",
        "GNU Library General Public License version 2": "",
        "Mozilla Public License version 2.0": "mpl-2.0",
        "Eclipse Public License, version 2.0": "epl-2.0",
        "public license version 2.0": "",
        "Apache License, Version 2.0": "apache,apache-2.0",
        "cc by cc by cc by": "cc-by",
        "CC BY 4.0": "cc-by,cc-by-4.0",
        "CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "Creative Commons Attribution NonCommercial 4.0 International License": "",
        "by 4 0 4 0": "",
        "2 0 2 0 2 0 license version 2 0 2 0": "",
        " ".join(w for i, w in enumerate(dict(map(reversed, license.TEMPLATES))["mit-full"].split()) if i != 40): "mit-full,mit-text",
        dict(map(reversed, license.TEMPLATES))["bsd-full"].upper().replace(" ", "\n"): "bsd-full,bsd-text",
        "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software": "mit-text",
    }
    texts = list(want)
    got = {r["doc_id"]: r for r in license.scan_licenses(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert {t: got[i]["labels"] for i, t in enumerate(texts)} == want
    assert all(len({m["label"] for m in got[i]["matches"]}) == len(set(filter(None, want[t].split(",")))) for i, t in enumerate(texts))


def test_license_sql_agrees(spark, tmp_path):
    """The SQL is written on its own: places by counting in the words, spans from the lists of hits."""
    import random

    import duckdb

    rnd = random.Random(4)
    pool = [w for text, _ in [*license.PHRASES, *license.TEMPLATES] for w in text.split()]
    texts = [None, "", "by 4 0 4 0", "2 0 2 0 2 0 license version 2 0 2 0"]
    for _ in range(400):
        w = []
        for _ in range(rnd.randint(1, 3)):
            w += rnd.choice([*license.PHRASES, *license.TEMPLATES])[0].split()
            w += [rnd.choice(pool) for _ in range(rnd.randint(0, 3))]
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [rnd.choice(pool)] * rnd.randint(0, 2)
            w = w or ["x"]
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), DOC)
    d.write.parquet(f"{tmp_path}/documents")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = {r[0]: r for r in duckdb.sql(license.SQL).fetchall()}
    got = {r["doc_id"]: tuple(r) for r in license.scan_licenses(d).drop("matches").collect()}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(r["labels"] != r["base_labels"] for r in license.scan_licenses(d).collect()) > 100
