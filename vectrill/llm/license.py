"""License scan by diagonal voting, with DataFrame functions only.

Every rolling hash of two and of three words of a document is joined to the positions that the
same hash has in license templates: three words for long wordings, two for short ones. A hit votes for the diagonal (document position minus template
position). Votes of neighbouring diagonals are merged, so small insertions don't split a
match. Each vote is verified word by word in the join, and each merged span as a whole: distinct
template positions count, the words that tell licences apart must stand at their places, and
no such word of another licence may stand between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.llm.common import words

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Wordings that may be inexact, with labels of their own.
TEMPLATES = [
    ("apache license version 2 0", "apache-2.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("eclipse public license version 2 0", "epl-2.0"),
    ("cc by nc 4 0", "cc-by-nc-4.0"),
    ("cc by sa 4 0", "cc-by-sa-4.0"),
    ("cc by nd 4 0", "cc-by-nd-4.0"),
    ("cc by 4 0", "cc-by-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("creative commons zero v1 0 universal", "cc0-1.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd-text"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc-text"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache-text"),
    ("this program is free software you can redistribute it and or modify it under the terms", "gpl-text"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "mit-full",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"
        " this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"
        " and or other materials provided with the distribution",
        "bsd-full",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc-full",
    ),
    (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
        "apache-full",
    ),
]
#: Wordings of at least so many words are matched by three words, shorter ones by two.
LONG = 12
#: Diagonals at most this far apart are merged; the share of a wording's positions that makes a label.
REACH, ACCEPT = 2, 0.8
#: Words that tell licences apart, besides numbers.
NAMES = "gnu general lesser library affero apache mozilla eclipse cc nc sa nd attribution noncommercial sharealike noderivatives noderivs zero".split()


def templates(phrases=PHRASES, wordings=TEMPLATES) -> list[tuple]:
    """(template, base, label, words of a hash, all votes, position, those words) for each position of each template."""
    out = []
    for t, (text, label) in enumerate([*phrases, *wordings]):
        w = text.split()
        k = 3 if t >= len(phrases) and len(w) >= LONG else 2
        if len(w) < k:
            raise ValueError(f"a template needs two words at least: {text!r}")
        out += [(t, t < len(phrases), label, k, len(w) - k + 1, i, " ".join(w[i : i + k])) for i in range(len(w) - k + 1)]
    return out


def _verified(names: list[str], reach: int) -> Column:
    """Whether the telling words of a wording (_t) stand at their places among the words near a
    span (_near, from place _from), and none but its own within the span (_lo to _hi)."""
    t, near, off = F.col("_t"), F.col("_near"), F.col("diag") - F.col("_from")

    def tells(x: Column) -> Column:
        return x.isin(*names) | x.rlike("^v?[0-9]+$")

    def place(x: Column, i: Column) -> Column:
        """Of a word in near, the first around position i; null if it is not there."""
        a = F.greatest(F.lit(0), i + off - reach)
        at = F.array_position(F.slice(near, a + 1, F.greatest(F.lit(0), i + off + reach + 1 - a)), x)
        return F.when(at > 0, (a + at - 1).cast("int"))

    # an end that no hit covers lies beyond the hits: words inserted before it are in the span, too
    first, last = F.element_at(t, 1), F.element_at(t, -1)
    lo = F.col("_lo") - F.col("_from")
    hi = F.col("_hi") - F.col("_from")
    lo = F.when(F.array_contains("merged", F.lit(0)), lo).otherwise(F.least(lo, place(first, F.lit(0))))
    hi = F.when(F.array_contains("merged", F.col("all") - 1), hi).otherwise(F.greatest(hi, place(last, F.size(t) - 1)))
    lo = F.greatest(F.lit(0), lo)
    span = F.slice(near, lo + 1, F.greatest(F.lit(0), hi - lo + 1))
    named = F.exists(t, tells)
    return F.forall(F.transform(t, lambda x, i: ~tells(x) | place(x, i).isNotNull()), lambda x: x) & ~(named & F.exists(span, lambda x: tells(x) & ~F.array_contains(t, x)))


def _sql(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def _spots(w: Column) -> Column:
    def of(k: int) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), *[F.get(w, i + n) for n in range(k)]).alias("h")))
        return F.when(F.size(w) >= k, at).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))

    return F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("h"))), of(2), of(3))


def scan_licenses(docs: DataFrame, *, phrases=PHRASES, wordings=TEMPLATES, reach: int = REACH, accept: float = ACCEPT, names=NAMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and matches (template label, first word, share of positions).

    A wording whose words include names or numbers needs them at their places, and no others
    within its span. score is the highest share of votes among the labels given, 0 without one. Null and empty
    texts have no words, no places and empty label strings. Repeated rows and null ids are
    each reported by themselves; extra columns are ignored. The templates are arguments, so
    the broadcast side has a fixed size; only hits and one row a document are shuffled.
    """
    spark: SparkSession = docs.sparkSession
    texts = [_sql(" ".join(text.split())) for text, _ in [*phrases, *wordings]]
    rows = ", ".join(f"({n}, {base}, '{_sql(label)}', {k}, {votes}, {at}, '{_sql(gram)}', '{texts[n]}')" for n, base, label, k, votes, at, gram in templates(phrases, wordings))
    t = spark.sql(f"SELECT * FROM VALUES {rows} AS v(t, base, label, k, votes, at, gram, wording)")
    g = F.split("gram", " ")
    t = t.select("*", F.when(F.col("k") == 2, F.xxhash64(F.lit(2), F.get(g, F.lit(0)), F.get(g, F.lit(1)))).otherwise(F.xxhash64(F.lit(3), F.get(g, F.lit(0)), F.get(g, F.lit(1)), F.get(g, F.lit(2)))).alias("_h"))
    w = F.col("_w")
    d = docs.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).alias("_id"), words(F.col(text)).alias("_w"))
    # inline_outer: the plain form infers a filter that would evaluate the whole array twice
    rows = d.select("_uid", "_id", "_w", _spots(w).alias("_s")).select("_uid", "_id", "_w", F.inline_outer("_s"))
    hits = rows.join(F.broadcast(t), rows["h"] == t["_h"], "left").filter((F.col("pos") == -1) | (F.concat_ws(" ", F.slice(w, F.col("pos") + 1, F.col("k"))) == F.col("gram")))
    diag = F.col("pos") - F.col("at")
    near = F.when(~F.col("base"), F.slice(w, F.greatest(F.lit(0), diag - reach) + 1, F.col("votes") + F.col("k") - 1 + 2 * reach + F.least(F.lit(0), diag)))
    diagonals = hits.groupBy("_uid", "t", diag.alias("diag")).agg(
        F.first("_id").alias("_id"), F.first("base").alias("base"), F.first("label").alias("label"), F.first("votes").alias("all"), F.first("k").alias("k"), F.max(F.when(F.col("pos") == -1, F.size(w))).alias("n"), F.count("at").alias("got"),
        F.first("wording").alias("wording"), F.first(near).alias("_near"), F.collect_set("at").alias("_at"),
    )
    around = W.partitionBy("_uid", "t").orderBy("diag").rangeBetween(-reach, reach)
    diagonals = diagonals.withColumn("_lo", F.min(F.col("diag") + F.array_min("_at")).over(around)).withColumn("_hi", F.max(F.col("diag") + F.array_max("_at") + F.col("k") - 1).over(around))
    diagonals = diagonals.withColumn("_from", F.greatest(F.lit(0), F.col("diag") - reach)).withColumn("_t", F.split("wording", " "))
    merged = F.array_distinct(F.flatten(F.collect_list("_at").over(around)))
    share = F.when(F.col("base"), (F.col("got") == F.col("all")).cast("double")).otherwise(F.size("merged") / F.col("all"))
    found = diagonals.withColumn("merged", merged).withColumn("share", F.when(F.col("t").isNotNull(), share))
    ok = F.when(F.col("base"), F.col("share") == 1.0).otherwise(F.when(F.col("share") >= accept, _verified(list(names), reach)).otherwise(False))
    place = F.when(ok & F.col("base"), F.col("diag").cast("long"))

    def labels(cond: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))

    return found.groupBy("_uid").agg(
        F.first("_id").alias("doc_id"), F.max("n").cast("long").alias("n_words"), F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        labels(ok & F.col("base")).alias("base_labels"), labels(ok).alias("labels"), F.coalesce(F.max(F.when(ok, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_set(F.when(ok, F.struct("label", F.col("diag").alias("first_word"), "share")))).alias("matches"),
    ).drop("_uid")


def query(spark, sf_dir):
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")


_ROWS = ", ".join(f"({t}, {base}, '{label}', {k}, {votes}, {at}, '{gram}')" for t, base, label, k, votes, at, gram in templates())
_TEXTS = ", ".join(f"({t}, {text.split()})" for t, (text, _) in enumerate([*PHRASES, *TEMPLATES]))
_TELLS = f"({{0}} IN ({', '.join(map(repr, NAMES))}) OR regexp_full_match({{0}}, 'v?[0-9]+'))"
#: A telling word's nearest place is looked for among the document's words themselves, from {REACH} before to {REACH} after.
SQL = rf"""
WITH t(t, base, label, k, votes, off, gram) AS (VALUES {_ROWS}),
tw(t, tw) AS (VALUES {_TEXTS}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (2), (3)) AS s(k))),
diag AS (SELECT doc_id, t, base, label, k, votes, pos - off AS diag, count(*) AS got, list(off) AS offs FROM g JOIN t USING (k, gram) GROUP BY ALL),
near AS (SELECT a.doc_id, a.t, a.base, a.label, a.k, a.votes, a.diag, a.got, list_distinct(flatten(list(b.offs))) AS merged, min(b.diag + list_min(b.offs)) AS lo, max(b.diag + list_max(b.offs) + a.k - 1) AS hi
         FROM diag a JOIN diag b ON a.doc_id = b.doc_id AND a.t = b.t AND abs(a.diag - b.diag) <= {REACH} GROUP BY ALL),
s AS (SELECT *, CASE WHEN base THEN CASE WHEN got = votes THEN 1.0 ELSE 0.0 END ELSE CAST(len(merged) AS DOUBLE) / votes END::DOUBLE AS share FROM near),
full_ AS (SELECT s.*, tw, w FROM s JOIN tw USING (t) JOIN d USING (doc_id) WHERE share >= CASE WHEN base THEN 1.0 ELSE {ACCEPT} END),
word AS (SELECT doc_id, t, diag, i - 1 AS i, len(tw) AS n, tw[i] AS x, (SELECT min(p) FROM range(greatest(0, diag + i - 1 - {REACH}), diag + i + {REACH}) AS r(p) WHERE w[p + 1] = tw[i]) AS spot
         FROM (SELECT *, unnest(range(1, len(tw) + 1)) AS i FROM full_ WHERE NOT base)),
ends AS (SELECT doc_id, t, diag, min(spot) FILTER (i = 0) AS first_at, min(spot) FILTER (i = n - 1) AS last_at, bool_or({_TELLS.format("x")}) AS named, bool_and(NOT {_TELLS.format("x")} OR spot IS NOT NULL) AS placed FROM word GROUP BY ALL),
span AS (SELECT f.*, named, placed, greatest(0, CASE WHEN list_contains(merged, 0) THEN lo ELSE least(lo, first_at) END) AS a, CASE WHEN list_contains(merged, votes - 1) THEN hi ELSE greatest(hi, last_at) END AS z
         FROM full_ f LEFT JOIN ends USING (doc_id, t, diag)),
ok AS (SELECT * FROM span WHERE base OR (placed AND NOT (named AND len(list_filter(w[greatest(a, diag - {REACH}) + 1:least(z, diag + len(tw) - 1 + {REACH}) + 1], lambda x: {_TELLS.format("x")} AND NOT list_contains(tw, x))) > 0))),
r AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(diag) FILTER (base) AS first_word, max(diag) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM ok GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""
