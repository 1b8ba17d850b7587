"""Personal data: candidate spans judged by boosted trees, with DataFrame functions only.

Strict rules give the base spans of e-mail addresses, IP addresses, payment cards and phone
numbers. Loose generators propose further candidates that overlap those and each other. Of
what they propose, gradient-boosted trees pick the rest by format and context. They learn from
spans that a rule confirms, each also rewritten so that no rule confirms it (another separator,
an accent, ``(at)``), against candidates that no span of their kind touches. A threshold for
each kind, calibrated on the documents that the trees haven't seen, selects what is added.

Matches become rows at once: their places are running sums over windows, and overlaps are
decided by sorted sweeps, so a text of many spans costs no more a span than one of few.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrill.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone")
#: As the plain rules, but a run is tried from its start only, a card from 13 digits on, and groups
#: are possessive: the same matches without quadratic search or deep recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators that keep to usual groupings, so that they find what a rule loses in a longer run.
TIGHT = {
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20./-][0-9]{4}){2}[\x20./-][0-9]{1,7})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20./-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: Generators of high recall.
LOOSE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+ ?(?:@|[(\[]at[)\]]) ?[\p{L}\p{N}-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[\p{L}\p{N}-]++)++",
    "ip": r"(?<![0-9.,])[0-9]++(?:[.,:][0-9]++){3}|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,22}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00|\()?[0-9][\x20()./0-9-]{6,18}[0-9](?![0-9])",
}
GENERATORS = (BASE, TIGHT, LOOSE)
#: Cheap tests that a text must pass before a pattern is tried.
HINT = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9][.,:][0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9](?:[\x20./-]?[0-9]){11}", "phone": r"[0-9][\x20()./0-9-]{6}"}
#: Documents whose candidates train the trees at most, those with the smallest hash of their id in one half;
#: all of the other half calibrate. Share of right ones among the selected there.
SAMPLE, PRECISION = 20_000, 0.98
TREES, DEPTH = 10, 4
#: Examples of a leaf at least: a candidate counts as wrong while no rule confirms it, so one alone must not make a leaf.
LEAF = 10
FEATURES = ["kind", "length", "digits", "letters", "seps", "groups", "longest", "at", "dots", "luhn", "octets", "kinds_of_digit", "cue", "quoted", "before_word", "after_word", "cross"]
_CUES = r"(?i)(?:tel|phone|call|fax|mobile|contact|card|visa|account|mail|write|ip|host|addr|server)[^\p{L}\p{N}]{0,4}$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn test."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(c.cast("int") * (1 + i % 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _octets(m: Column) -> Column:
    def small(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare).between(1, 3), bare.cast("int")).otherwise(0) <= 255)

    return F.forall(F.split(m, r"\."), small)


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of the strict rule counts."""
    d = _digits(m)
    n = F.length(d)
    card = F.when(n.between(13, 19), luhn(d)).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, _octets(m)).when(kind == 2, card).otherwise(n.between(9, 15))


_MATCH = "array<struct<kind:int,gen:int,i:int,m:string,before:string,after:string,gap:int,len:int>>"


def _matches(docs: DataFrame) -> DataFrame:
    """One row a match and generator, and one (kind -1) a document: _uid, _id, kind, gen, start, end, m, before, after."""
    none = F.array().cast("array<string>")
    runs = [(n, g, f"_{g}{k}", k, patterns[k]) for g, patterns in enumerate(GENERATORS) for n, k in enumerate(KINDS) if k in patterns]
    d = docs
    for k in KINDS:
        d = d.withColumn(f"_h{k}", F.col("_t").rlike(HINT[k]))
    for _, _, c, k, p in runs:
        d = d.withColumn(f"{c}_m", F.when(F.col(f"_h{k}"), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(none))
    for _, _, c, _, p in runs:
        d = d.withColumn(f"{c}_p", F.when(F.size(f"{c}_m") > 0, F.split("_t", p, -1)).otherwise(none))

    def rows(n: int, g: int, c: str) -> Column:
        """Matches with the pieces of text around them."""
        size = F.size(f"{c}_m")
        zipped = F.arrays_zip(F.col(f"{c}_m").alias("m"), F.slice(f"{c}_p", F.lit(1), size).alias("b"), F.slice(f"{c}_p", F.lit(2), size).alias("a"))
        one = lambda x, i: F.struct(F.lit(n).alias("kind"), F.lit(g).alias("gen"), i.alias("i"), x["m"].alias("m"), F.right(x["b"], F.lit(16)).alias("before"), F.left(x["a"], F.lit(2)).alias("after"), F.char_length(x["b"]).alias("gap"), F.char_length(x["m"]).alias("len"))
        return F.when(size > 0, F.transform(zipped, one)).otherwise(F.array().cast(_MATCH))

    each = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(-1).alias("gen"), F.lit(0).alias("i"), *[F.lit(None).cast("string").alias(c) for c in ("m", "before", "after")], F.lit(0).alias("gap"), F.lit(0).alias("len")))
    d = d.select("_uid", "_id", F.concat(each, *[rows(n, g, c) for n, g, c, _, _ in runs]).alias("_rows")).select("_uid", "_id", F.inline_outer("_rows"))
    so_far = W.partitionBy("_uid", "kind", "gen").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    d = d.repartition("_uid").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int"))
    return d.select("_uid", "_id", "kind", "gen", (F.col("end") - F.col("len")).alias("start"), "end", "m", "before", "after")


def _touches(rows: DataFrame, which: Column, by: list[str], name: str) -> DataFrame:
    """rows with whether any row that `which` tells, among those equal in `by`, overlaps it."""
    # a sweep: telling rows come at their start, others at their end; the furthest end so far decides
    sweep = W.partitionBy(*by).orderBy(F.when(which, F.col("start")).otherwise(F.col("end")), F.when(which, 1).otherwise(0)).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, ~which & F.coalesce(F.max(F.when(which, F.col("end"))).over(sweep) > F.col("start"), F.lit(False)))


def candidates(docs: DataFrame) -> DataFrame:
    """docs(_uid, _id, _t) as rows of matches with flags: base (a strict match that counts), inside
    (within a base span), own (touches a base span of its kind), unsure (touches a strict match of
    its kind that doesn't count and isn't the same span), cross (touches a base span of another kind)."""
    d = _matches(docs).withColumn("base", F.when(F.col("gen") == 0, _valid(F.col("kind"), F.col("m"))).otherwise(False))
    d = d.withColumn("_failed", (F.col("gen") == 0) & ~F.col("base"))
    d = _touches(d, F.col("base"), ["_uid", "kind"], "own")
    d = _touches(d, F.col("base"), ["_uid"], "cross").withColumn("cross", F.col("cross") & ~F.col("own"))
    d = _touches(d, F.col("_failed"), ["_uid", "kind"], "unsure")
    itself = F.max("_failed").over(W.partitionBy("_uid", "kind", "start", "end"))
    d = d.withColumn("unsure", F.col("unsure") & ~itself)
    within = W.partitionBy("_uid").orderBy("start", F.when(F.col("base"), 0).otherwise(1)).rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("inside", ~F.col("base") & F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(within) >= F.col("end"), F.lit(False))).drop("_failed")


def _features(rows: DataFrame) -> DataFrame:
    """Format and context figures of a match."""
    m, before, after = F.col("m"), F.col("before"), F.col("after")
    d = _digits(m)
    groups = F.array_remove(F.split(m, "[^0-9]+"), "")
    num = {
        "kind": F.col("kind"), "length": F.char_length(m), "digits": F.length(d), "letters": F.length(F.regexp_replace(m, r"[^\p{L}]", "")), "seps": F.length(F.regexp_replace(m, r"[\p{L}\p{N}]", "")),
        "groups": F.size(groups), "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "at": m.rlike(r"@|[(\[]at[)\]]").cast("int"),
        "dots": F.length(F.regexp_replace(m, r"[^.]", "")), "luhn": ((F.length(d) > 0) & luhn(d)).cast("int"), "octets": (F.size(groups) == 4).cast("int") * _octets(F.concat_ws(".", groups)).cast("int"),
        "kinds_of_digit": F.size(F.array_distinct(F.split(d, ""))), "cross": F.col("cross").cast("int"), "cue": before.rlike(_CUES).cast("int"), "quoted": before.rlike("[\"'=:]\\s*$").cast("int"),
        "before_word": before.rlike(r"\p{L}$").cast("int"), "after_word": after.rlike(r"^\p{L}").cast("int"),
    }
    rows = rows.select("*", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"_{k}") for k, v in num.items()])
    return VectorAssembler(inputCols=[f"_{k}" for k in FEATURES], outputCol="_x").transform(rows).drop(*[f"_{k}" for k in FEATURES])


def _rewritten(kind: Column, m: Column) -> Column:
    """A span of one's kind in a writing that its strict rule doesn't confirm."""
    email = F.when(F.length(m) % 2 == 0, F.regexp_replace(m, "@", " (at) ")).otherwise(F.translate(m, "aeio", "áéíó"))
    ip = F.regexp_replace(m, r"\.", ",")
    card = F.when(m.rlike("[ -]"), F.regexp_replace(m, "[ -]", ".")).otherwise(F.regexp_replace(m, "([0-9]{4})(?=[0-9])", "$1."))
    return F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).otherwise(F.regexp_replace(m, r"^\+", "00"))


def _examples(found: DataFrame) -> DataFrame:
    """Labelled matches: confirmed spans and their other writings (1), candidates that touch none of
    their kind nor a longer or shorter strict match that failed, which may hold one (0)."""
    c = ["_o", "kind", "before", "after", "cross"]
    right = found.filter("base").select(*c, "m")
    other = right.select(*c, _rewritten(F.col("kind"), F.col("m")).alias("m"))
    wrong = found.filter("gen > 0 AND NOT own AND NOT unsure").select(*c, "m")
    return right.unionByName(other).withColumn("_label", F.lit(1.0)).unionByName(wrong.withColumn("_label", F.lit(0.0)))


def _score(model, rows: DataFrame) -> DataFrame:
    return model.transform(_features(rows)).withColumn("_p", F.get(vector_to_array("probability"), F.lit(1)))


def train(found: DataFrame, *, sample: int = SAMPLE, precision: float = PRECISION):
    """(trees, {kind number: threshold}), or None where the examples to learn from are of one class.

    found: the written rows of `candidates` with _o, a hash of the document. A kind without a
    threshold at which the share of right ones among the selected is at least `precision` has none,
    and adds nothing.
    """
    rows = _examples(found)
    fit = F.pmod(F.col("_o"), F.lit(2)) == 0
    ends = rows.filter(fit).select("_o").distinct().orderBy("_o").limit(sample).agg(F.max("_o")).first()[0]
    if ends is None:
        return None
    some = rows.filter(fit & (F.col("_o") <= ends))
    if some.select("_label").distinct().count() < 2:
        return None
    gbt = GBTClassifier(featuresCol="_x", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.3, minInstancesPerNode=LEAF, seed=1, cacheNodeIds=False)
    model = gbt.fit(_features(some).select("_x", "_label"))
    steps = _score(model, rows.filter(~fit)).groupBy("kind", F.floor(F.col("_p") * 200).alias("s")).agg(F.count("*").alias("n"), F.sum("_label").alias("y")).orderBy("kind", F.desc("s")).collect()  # 4 x 201 rows at most
    best: dict[int, float] = {}
    for kind in range(len(KINDS)):
        n = y = 0.0
        own = [r for r in steps if r["kind"] == kind]
        for r, after in zip(own, [*own[1:], None]):
            n, y = n + r["n"], y + r["y"]
            if r["y"] and y >= precision * n:  # half way to the next lower score that any example has
                best[kind] = (r["s"] + (after["s"] + 1 if after else 0)) / 400
    return model, best


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    and found, an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans. Where the candidates are all confirmed or none is, the base
    spans are all. A selected candidate within a base span adds nothing; one that reaches beyond it
    is added beside it. Of selected candidates that overlap, those of the tight
    generators stay. Repeated rows and null ids are reported each; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    src = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).withColumn("_uid", F.monotonically_increasing_id())
    found = scratch.table(candidates(src), "matches")
    trained = train(found.filter("kind >= 0").withColumn("_o", F.xxhash64(F.coalesce("_id", "_uid"), F.lit("pii"))), **options)
    span = F.struct("kind", "start", "end")
    base = found.filter("kind < 0 OR base").select("_uid", "_id", F.when(F.col("base"), span).alias("b"), F.when(F.col("base"), span).alias("x"))
    if trained is not None:
        model, best = trained
        least = F.element_at(F.array(*[F.lit(best.get(k, 2.0)) for k in range(len(KINDS))]), F.col("kind") + 1)
        picked = _score(model, found.filter("gen > 0 AND NOT inside")).filter(F.col("_p") >= least).select("_uid", "_id", "kind", "gen", "start", "end")
        picked = _touches(picked, F.col("gen") == 1, ["_uid"], "_double").filter(~F.col("_double"))
        base = base.unionByName(picked.select("_uid", "_id", F.lit(None).cast("struct<kind:int,start:int,end:int>").alias("b"), span.alias("x")))
    per = base.groupBy("_uid").agg(F.first("_id").alias("_id"), F.array_sort(F.collect_list("b")).alias("base"), F.array_sort(F.collect_set("x")).alias("all"))

    def code(a: str) -> Column:
        name = lambda n: F.element_at(F.array(*map(F.lit, KINDS)), n + 1)
        return F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))

    def count(n: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    return per.select(
        F.col("_id").alias("doc_id"), *[count(n) for n in range(4)], F.sha2(code("base").cast("binary"), 256).alias("base_sha256"), code("all").alias("spans"),
        F.transform("all", lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"),
    )


def query(spark, sf_dir):
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
